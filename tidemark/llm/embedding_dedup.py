"""Operator 12: near-duplicate embeddings by product quantisation.

Rows alike in label and vector are one *node*, so exact copies meet once.

* **Index.** Coarse centroids (unit vectors, about the square root of the
  number of rows, 8,192 at most, none within twice the threshold's angle of
  another) and, for the residuals, 256 codewords in each
  of 8 subspaces. Both are fitted on at most ``SAMPLE`` rows; every node is
  indexed: its *home* is the list of its nearest centroid.
* **Probes.** A code (8 bytes, with its home and its bound) is posted to the
  home and to every list whose border the vector lies near: a partner may have
  crossed it. The distance allowed is ``SPREAD`` standard deviations of a
  partner at the threshold, from either side, so a link is missed only where
  the two are over ``2 * SPREAD`` apart across every border.
* **Asymmetric distances.** In a list, each member's table of products with the
  codewords gives its estimated cosine with all posted codes by look-ups. A
  code's bound is what a linked vector's estimate cannot fall below, whatever
  the quantisation error, so this step loses no link.
* **Exact rerank.** Only vectors with a candidate go on, to their home and to
  the lists they must visit. There cosines are matrix products in double
  precision: each member counts its links, and the links leave a task as a
  spanning forest of its block. A pair is counted in the list of the larger
  home, so once.

Nothing lists pairs. Members of a list are dealt into blocks of ``BLOCK``;
codes and visitors stream past a block in chunks, so a list of any size takes
bounded memory; a cluster of m vectors costs m^2 products in ``m / BLOCK``
tasks, each of which reads its rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without a label, link with nothing and stay; vectors of
different lengths do not link; repeated rows are vectors each, and link with
their copies; repeated vec_ids with different vectors are vectors each, and
``component_id`` is the least id among a component's rows; a null vec_id is
the smallest id; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample
from tidemark.llm.components import components
from tidemark.operators.joins import broadcast_if_small
from tidemark.session import stage_table

#: Most coarse lists, most rows that the index is fitted on, rounds of fitting.
LISTS, SAMPLE, ROUNDS = 8192, 131_072, 6
#: Subspaces, and codewords of each.
PARTS, WORDS = 8, 256
#: Standard deviations that a probe reaches over a border.
SPREAD = 2.2
#: Members of a block, codes or visitors of a chunk, members of a table.
BLOCK, CHUNK, QUERIES = 16_384, 4096, 1024
_NULL_ID = -(1 << 63)


class Index(NamedTuple):
    """Unit centroids, and the codewords (part, word, component)."""

    centroids: np.ndarray
    words: np.ndarray
    share: float

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _fitted(points: np.ndarray, k: int, random: np.random.Generator, unit: bool) -> np.ndarray:
    """``k`` centres of some points (fewer where points are fewer)."""
    centres = points[random.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(points[i:i + CHUNK] @ centres.T - (0 if unit else (centres ** 2).sum(1) / 2)).argmax(1)
                               for i in range(0, len(points), CHUNK)])
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        centres[full] = np.add.reduceat(points[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
        if unit:
            size = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.divide(centres, size, out=np.zeros_like(centres), where=size > 0)
    return centres


def _apart(centroids: np.ndarray, share: float) -> np.ndarray:
    """Centroids over twice the threshold's angle from all before them: no
    border between lists runs through a group of linked vectors."""
    kept = np.zeros_like(centroids)
    n = 0
    for c in centroids:
        if n == 0 or (kept[:n] @ c).max() < 2 * share * share - 1:
            kept[n] = c
            n += 1
    return kept[:n]


def fit(sample: np.ndarray, lists: int, share: float) -> Index:
    """The index of some unit vectors (float32, their length a multiple of ``PARTS``)."""
    random = np.random.Generator(np.random.PCG64(12))
    centroids = _apart(_fitted(sample, lists, random, True), share)
    some = sample[:16_384]
    rest = some - centroids[(some @ centroids.T).argmax(1)]
    parts = rest.reshape(len(rest), PARTS, -1)
    words = np.stack([_fitted(np.ascontiguousarray(parts[:, m]), WORDS, random, False) for m in range(PARTS)])
    return Index(centroids, words, share)


def _sample(column: pa.ListArray, dim: int) -> np.ndarray:
    sizes = pc.list_value_length(column).to_numpy()
    of = [np.flatnonzero(sizes == d) for d in np.unique(sizes)]
    return np.concatenate([unit(column.take(pa.array(i)).flatten().to_numpy().reshape(len(i), -1), dim) for i in of]).astype(np.float32)


def unit(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Rows scaled to length one in double precision, with zeros up to ``dim``."""
    out = np.zeros((len(vectors), dim))
    out[:, :vectors.shape[1]] = vectors
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def entries(index: Index, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Home, code and bound of some unit vectors; (vector, list) of their probes."""
    x = u.astype(np.float32)
    near = x @ index.centroids.T
    home = near.argmax(1)
    own = index.centroids[home]
    parts = (x - own).reshape(len(x), PARTS, -1)
    code = np.stack([(parts[:, m] @ index.words[m].T - (index.words[m] ** 2).sum(1) / 2).argmax(1) for m in range(PARTS)], 1)
    rest = u - (own + np.concatenate([index.words[m][code[:, m]] for m in range(PARTS)], 1))
    # the code's vector is (1 - along) u plus a part across u; a linked vector is at most the threshold's angle away
    along = (rest * u).sum(1)
    across = np.sqrt(np.maximum((rest * rest).sum(1) - along * along, 0))
    sine = math.sqrt(1 - index.share ** 2)
    bound = np.minimum(1 - along, index.share * (1 - along) - sine * across) - 1e-4
    apart = np.sqrt(np.maximum(2 - 2 * (own @ index.centroids.T), 1e-12))
    probe = (near[np.arange(len(x)), home][:, None] - near) <= SPREAD * sine / math.sqrt(index.dim) * apart
    probe[np.arange(len(x)), home] = True
    return home, code.astype(np.uint8), bound.astype(np.float32), *np.nonzero(probe)


_ASSIGNED = "nid long, label long, d int, a long, b long, vec_id long, copies long, home int, vector binary, code binary, bound float, probes array<int>"


def assigned(nodes: DataFrame, index: Index, dtype: str) -> DataFrame:
    """``nodes`` with home, code, bound and probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for d in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == d)
                for at in range(0, len(of), CHUNK):
                    part = batch.take(pa.array(of[at:at + CHUNK]))
                    raw = part.column("embedding").flatten().to_numpy().astype(dtype).reshape(-1, d)
                    home, code, bound, who, where = entries(index, unit(raw.astype(np.float64), index.dim))
                    offsets = pa.array(np.searchsorted(who, np.arange(len(raw) + 1)).astype(np.int32))
                    yield pa.record_batch(
                        [part.column("nid"), part.column("label"), pa.array(np.full(len(raw), d, np.int32)), part.column("a"), part.column("b"), part.column("vec_id"), part.column("copies"),
                         pa.array(home.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()),
                         pa.array(bound), pa.ListArray.from_arrays(offsets, pa.array(where.astype(np.int32)))],
                        [c.split()[0] for c in _ASSIGNED.split(", ")])

    return nodes.select("nid", "label", "a", "b", "vec_id", "copies", "embedding").mapInArrow(run, _ASSIGNED)


_LIST = ["label", "d", "list"]
_KEY = [*_LIST, "block"]


def _blocks(members: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """``tables`` with the number of blocks of each row's list. Only lists of
    over one block are joined: at most a row for every ``BLOCK`` members."""
    large = members.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    side = broadcast_if_small(stage_table(large.select(*_LIST, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "lists"))
    return [t.join(side, _LIST, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for t in tables]


def _own_block() -> Column:
    return F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block")


def _each_block() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")




def _streamed(batches: Iterator[pa.RecordBatch], start, step, finish) -> Iterator[pa.RecordBatch]:
    """Groups of rows that lie next to each other: ``start`` with all rows of
    kind 0, ``step`` with each chunk of kind 1, then ``finish``."""
    key, state, base = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*_KEY, "kind"]]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            now, kind = tuple(c[lo] for c in columns[:-1]), columns[-1][lo]
            if now != key:
                if state is not None:
                    yield from finish(state)
                key, state, base = now, None, []
            if kind == 0:
                base.append(batch.slice(lo, hi - lo))
                continue
            if state is None and base:
                state, base = start(pa.Table.from_batches(base), now), []
            if state is not None:
                for at in range(lo, hi, CHUNK):
                    yield from step(state, batch.slice(at, min(CHUNK, hi - at)))
    if state is not None:
        yield from finish(state)


def _units(column, d: int, dtype: str, dim: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, d).astype(np.float64), dim)


class _List:
    """A block's members, their tables, and where candidates have to meet."""

    def __init__(self, index: Index, dtype: str, rows: pa.Table, key: tuple):
        self.index, self.home = index, int(key[2])
        self.nid = rows.column("nid").to_numpy()
        self.x = _units(rows.column("vector"), int(key[1]), dtype, index.dim).astype(np.float32)
        self.seen: set[tuple[int, int]] = set()

    def look(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        home = batch.column("home").to_numpy()
        order = np.argsort(home, kind="stable")
        home, nid, bound = home[order], batch.column("nid").to_numpy()[order], batch.column("bound").to_numpy()[order]
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)[order]
        lists, first = np.unique(home, return_index=True)
        mine = np.zeros(len(nid), bool)
        for at in range(0, len(self.x), QUERIES):
            x = self.x[at:at + QUERIES]
            near = np.ascontiguousarray(self.index.centroids[lists] @ x.T)
            guess = near[np.repeat(np.arange(len(lists)), np.diff(np.append(first, len(home))))]
            for m, part in enumerate(np.split(x, PARTS, axis=1)):
                guess += (self.index.words[m] @ part.T)[code[:, m]]
            hit = guess >= bound[:, None]
            _, y, q = np.intersect1d(nid, self.nid[at:at + QUERIES], return_indices=True)
            hit[y, q] = False
            mine |= hit.any(1)
            met = np.logical_or.reduceat(hit, first, axis=0)
            for i, q in zip(*(v.tolist() for v in np.nonzero(met)), strict=True):
                self.seen.add((int(self.nid[at + q]), max(self.home, int(lists[i]))))
                self.seen.add((int(self.nid[at + q]), self.home))
        found = np.flatnonzero(mine)
        away = found[home[found] < self.home]
        yield from _visits(np.concatenate((nid[found], nid[away])), np.concatenate((home[found], np.full(len(away), self.home))))

    def rows(self) -> Iterator[pa.RecordBatch]:
        at = np.array(sorted(self.seen), np.int64).reshape(-1, 2)
        yield from _visits(at[:, 0], at[:, 1])


def _visits(nid: np.ndarray, lists: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(nid):
        yield pa.record_batch([pa.array(nid, pa.int64()), pa.array(lists.astype(np.int32))], ["nid", "list"])


def visits(table: DataFrame, index: Index, dtype: str) -> DataFrame:
    """(nid, list): where the vectors with a candidate have to be compared."""
    members = table.select("label", "d", F.col("home").alias("list"), "nid", "home", "vector")
    posted = table.select("label", "d", F.explode("probes").alias("list"), "nid", "home", "code", "bound")
    empty = lambda kind: F.lit(None).cast(kind)
    base, codes = _blocks(members, members, posted)
    base = base.select(*_LIST, _own_block(), F.lit(0).alias("kind"), "nid", "home", "vector",
                       empty("binary").alias("code"), empty("float").alias("bound"))
    codes = codes.select(*_LIST, _each_block(), F.lit(1).alias("kind"), "nid", "home",
                         empty("binary").alias("vector"), "code", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _streamed(batches, lambda rows, key: _List(index, dtype, rows, key), _List.look, _List.rows)

    return (base.unionByName(codes).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind")
            .mapInArrow(run, "nid long, list int").distinct())


class _Block:
    """A block's members, their links counted and joined."""

    def __init__(self, share: float, dtype: str, rows: pa.Table, key: tuple):
        self.share, self.dtype, self.d, self.home = share, dtype, int(key[1]), int(key[2])
        self.nid, self.copies = rows.column("nid").to_numpy(), rows.column("copies").to_numpy()
        self.x = _units(rows.column("vector"), self.d, dtype, self.d)
        self.count = np.zeros(len(self.nid), np.int64)
        self.root = np.arange(len(self.nid))

    def compare(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nid, copies = batch.column("nid").to_numpy(), batch.column("copies").to_numpy()
        linked = self.x @ _units(batch.column("vector"), self.d, self.dtype, self.d).T >= self.share
        _, x, y = np.intersect1d(self.nid, nid, return_indices=True)
        linked[x, y] = False
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            return
        linked = linked[np.ix_(rows, cols)]
        self.count[rows] += linked @ copies[cols]
        self._join(rows, linked)
        visitor = batch.column("home").to_numpy()[cols] != self.home
        links = np.where(visitor, self.copies[rows] @ linked, 0)  # members count theirs in their own block
        yield from _links(nid[cols], self.nid[rows[linked.argmax(0)]], links)

    def _join(self, rows: np.ndarray, linked: np.ndarray) -> None:
        """Members linked with the same vector get the same, least, root."""
        while True:
            root = self.root[rows]
            least = np.where(linked, root[:, None], len(self.root)).min(0)
            new = np.where(linked, least[None, :], len(self.root)).min(1)
            if (new == root).all():
                return
            to = np.arange(len(self.root))
            np.minimum.at(to, root, new)
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.count)
        yield from _links(self.nid[some], self.nid[self.root[some]], self.count[some])


def _links(u: np.ndarray, v: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(u):
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], ["u", "v", "links"])


def compared(table: DataFrame, where: DataFrame, share: float, dtype: str) -> DataFrame:
    """(u, v, links): nodes, one with which each is connected, and parts of
    its number of links."""
    rows = where.join(table.select("nid", "label", "d", "home", "vector", "copies"), "nid")
    rows = stage_table(rows, "candidates")
    members = rows.where("home = list")
    cols = [F.col(c) for c in ("nid", "home", "vector", "copies")]
    base, others = _blocks(members, members, rows)
    base = base.select(*_LIST, _own_block(), F.lit(0).alias("kind"), *cols)
    others = others.select(*_LIST, _each_block(), F.lit(1).alias("kind"), *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _streamed(batches, lambda rows, key: _Block(share, dtype, rows, key), _Block.compare, _Block.rows)

    return (base.unionByName(others).repartition(*_KEY).sortWithinPartitions(*_KEY, "kind")
            .mapInArrow(run, "u long, v long, links long"))


def near_vectors(vectors: DataFrame, share: float = 0.93) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) as vec_id, n_links, component_id,
    kept: rows of one label link at a cosine of ``share`` or more."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")), F.lit(False)))
    valid = F.coalesce(finite & F.exists("embedding", lambda c: c != 0) & F.col("label").isNotNull(), F.lit(False))
    dtype = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NULL_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.when(valid, F.xxhash64("embedding")).alias("a"), F.when(valid, F.xxhash64(F.lit(1), "embedding")).alias("b"), "embedding")
    good = rows.where("a IS NOT NULL")
    n, longest = good.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    real = F.when(F.col("vec_id") != _NULL_ID, F.col("vec_id"))
    if not n:
        return rows.select(real.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), real.alias("component_id"), F.lit(True).alias("kept"))
    dim = -(-longest // PARTS) * PARTS
    lists = min(LISTS, 1 << math.ceil(math.log2(math.sqrt(n))))
    drawn = hashed_sample(good.select("embedding", F.monotonically_increasing_id().alias("row")), F.xxhash64("row"), n, min(SAMPLE, 64 * lists))
    index = fit(_sample(drawn.select("embedding").toArrow().column(0).combine_chunks(), dim), lists, share)
    nodes = good.groupBy("label", "a", "b").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    table = stage_table(assigned(nodes.withColumn("nid", F.monotonically_increasing_id()), index, dtype), "assigned")
    links = stage_table(compared(table, stage_table(visits(table, index, dtype), "visits"), share, dtype), "links")

    # a component is named by its least vec_id; the names are staged, so that a hot component can be split
    joined = stage_table(table.select("nid", "vec_id").join(components(links.select("u", "v"), "vectors"), F.col("nid") == F.col("node")), "joined")
    least = stage_table(joined.groupBy("root").agg(F.min("vec_id").alias("least")), "least")
    named = joined.join(least, "root").select("nid", "least")
    counted = links.groupBy(F.col("u").alias("nid")).agg(F.sum("links").alias("links"))
    told = stage_table(table.select("nid", "label", "a", "b", "vec_id", "copies").join(counted, "nid", "left").join(named, "nid", "left").select(
        "label", "a", "b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "vec_id").alias("least")), "told")
    out = rows.select("vec_id", "label", "a", "b").join(told, ["label", "a", "b"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select(real.alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(component != _NULL_ID, component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))
