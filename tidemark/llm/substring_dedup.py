"""Operator 4: repeated substrings by longest-previous-factor arrays.

A byte is removed when a string of ``LENGTH`` bytes that covers it also
starts elsewhere in the corpus. The suffix order of the whole corpus is never
built in one place. It is split by content, so that equal strings meet:

1. Every window of ``LENGTH`` bytes has an anchor, the leftmost least of its
   hashed ``GRAM``-byte grams. Equal windows have equal anchors at equal
   offsets, and the windows of one anchor are neighbours; together they are
   its *zone*, of ``2 * LENGTH - GRAM`` bytes at most.
2. Zones whose anchor occurs once hold no repeated window and are dropped by
   one aggregation over 8-byte keys.
3. Zones that occur twice or more as a whole are repeated as a whole: one
   aggregation per (anchor, zone), so copied passages cost a row per copy.
4. What is left are zones that share an anchor and differ, at the ends of
   copied passages. Their texts meet by anchor, and the suffix order of an
   anchor's zones gives the longest previous factor of each position: the
   longer of its common prefixes with the previous and the next smaller
   position in that order (and, with greater positions, the longest next
   factor). Lengths are exact up to ``LENGTH``, where suffixes are cut off.
5. An anchor with more than ``CROWD`` differing zones is not gathered: its
   windows are counted by hash in an ordinary aggregation instead.

Spans go back to their documents by key. Nothing is joined pairwise, and no
task holds more than one crowd of zones or one document.

``keep="none"`` removes all copies, ``keep="first"`` keeps the first in
(doc_id, position) order.

Defined results: null text is empty; texts under ``LENGTH`` bytes never lose
anything; matches never cross documents; overlapping repeats count; rows
alike in doc_id and text count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_hash import join, sliding_min, windows
from tidemark.llm.common import text_of
from tidemark.operators.joins import join_hot_split
from tidemark.session import stage_table

#: Bytes of a repeat, and of the grams that anchors are chosen from.
LENGTH, GRAM = 200, 40
#: Differing zones of one anchor that one task compares by suffix order.
CROWD = 10_000
#: Zones that make an anchor "hot": it is then joined without a shuffle.
HOT = 50_000
#: Bytes of zones ordered at once, and of text hashed at once.
ORDER_BYTES, SLICE = 3_000_000, 1_500_000

_PLACE = np.uint64((1 << 21) - 1)
_ANCHORS = "doc_id long, row long, anchor array<long>, zone array<long>, at array<int>, size array<int>"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` names a document by its contents."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return narrow.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of one text: their hash, zone hash, zone start and zone size,
    where a zone's windows start at ``start .. start + size - length``."""
    found = []
    for begin in range(0, max(1, len(data) - length + 1), SLICE):
        found.append(_anchors(data[begin:begin + SLICE + length - 1], begin, length, gram))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, begin: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = windows(data, [8, 32, 128])
    grams = join(h[32][:len(data) - gram + 1], h[8][gram - 8:])
    place = np.arange(len(grams), dtype=np.uint64)  # under 2^21, see SLICE
    least = sliding_min((grams & ~_PLACE) | place, length - gram + 1) & _PLACE  # of each window, the leftmost of ties
    start = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1))
    size = np.diff(np.concatenate((start, [len(least)]))) + length - 1
    wide, end = h[128], start + size - 128
    zone = join(join(wide[start], wide[start + (size - 128) // 2]), join(wide[end], size.astype(np.uint64)))
    return grams[least[start].astype(np.int64)], zone, start + begin, size


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {k: [] for k in ("anchor", "zone", "at", "size")}
        for text in batch.column("text"):
            found = anchors(np.frombuffer(text.as_py().encode(), np.uint8))
            for k, x in zip(cols, found, strict=True):
                cols[k].append(x)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in cols["at"]]))), pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cols[k]).astype(t)))
                  for k, t in (("anchor", np.int64), ("zone", np.int64), ("at", np.int32), ("size", np.int32))]
        yield pa.record_batch([batch.column("doc_id"), batch.column("row"), *arrays],
                              ["doc_id", "row", "anchor", "zone", "at", "size"])


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 on (equal ranks: equal keys)."""
    order = np.argsort(keys)
    listed = keys[order]
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.cumsum(np.concatenate(([1], listed[1:] != listed[:-1])))
    return rank


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The first eight bytes of each suffix as a number, and its ranks when cut
    off at 8, 16, ... bytes, the last time at ``length`` (8 or more).
    Positions past the end count as zero."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i:i + len(data)]
    n, ranks = 8, {8: _rank(words)}
    while n < length:
        step = min(n, length - n)
        rank = ranks[n].astype(np.uint64)
        behind = np.concatenate((rank[step:], np.zeros(min(step, len(rank)), np.uint64)))[:len(rank)]
        n += step
        ranks[n] = _rank((rank << np.uint64(32)) | behind)
    return words, ranks


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, ranks: dict[int, np.ndarray], length: int = LENGTH) -> np.ndarray:
    """The common prefix of each pair of suffixes, up to ``length`` bytes."""
    size, last = np.zeros(len(a), np.int64), len(words) - 1
    for n in sorted(ranks, reverse=True):
        if n < length:
            rank = ranks[n]
            at, bt = np.minimum(a + size, last), np.minimum(b + size, last)
            size += n * ((rank[at] == rank[bt]) & (size + n <= length))
    differ = words[np.minimum(a + size, last)] ^ words[np.minimum(b + size, last)]
    for i in range(1, 9):
        size += (differ >> np.uint64(64 - 8 * i)) == 0
    whole = ranks[max(ranks)]
    return np.where(whole[a] == whole[b], length, np.minimum(size, length - 1))


def nearest_smaller(at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order, its common prefix with the nearest
    entry before it whose position is smaller; none: 0. ``at`` holds the
    positions, ``prefix`` the common prefix of each entry with the one before.

    An entry points at the one before and, while that lies at a greater
    position, follows its pointer: all that is jumped over is greater too."""
    before, size = np.arange(-1, len(at) - 1), prefix.copy()
    open_ = np.flatnonzero(size > 0)
    open_ = open_[at[before[open_]] > at[open_]]
    while len(open_):
        via = before[open_]
        size[open_], before[open_] = np.minimum(size[open_], size[via]), before[via]
        open_ = open_[size[open_] > 0]
        open_ = open_[at[before[open_]] > at[open_]]
    return size


def factors(at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The longest previous factor of each entry of a suffix order: the longer
    of its common prefixes with the previous and the next smaller position.
    Entries alike in ``LENGTH`` bytes follow the least position of their run,
    which alone has to look beyond it."""
    if not len(at):
        return prefix
    first = prefix < LENGTH
    start = np.flatnonzero(first)
    least, prefix = np.minimum.reduceat(at, start), prefix[start]
    back = np.concatenate(([0], prefix[:0:-1]))
    found = np.maximum(nearest_smaller(least, prefix), nearest_smaller(least[::-1], back)[::-1])
    run = np.cumsum(first) - 1
    return np.where(at == least[run], found[run], LENGTH)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _compare(first: bool):
    """Zones sorted by anchor, then position, as (anchor, zone, runs of
    repeated windows)."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        texts = [r[2] for r in rows]
        data = np.frombuffer(b"".join(texts), np.uint8)
        previous, following = factors_within(data, [len(t) for t in texts], [r[0] for r in rows], both=not first)
        flags, at = np.maximum(previous, following) >= LENGTH, 0
        for (anchor, zone, text) in rows:
            start, size = _runs(flags[at:at + len(text) - LENGTH + 1])
            at += len(text)
            if len(start):
                yield anchor, zone, [{"at": int(s), "n": int(n)} for s, n in zip(start, size, strict=True)]

    schema = pa.schema([("anchor", pa.int64()), ("zone", pa.int64()),
                        ("runs", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, out = [], 0, []

        def flush():
            out = list(solve(rows))
            return pa.record_batch([pa.array([r[i] for r in out], schema[i].type) for i in range(3)], schema=schema)

        for batch in batches:
            for anchor, zone, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "zone", "text")), strict=True):
                if size >= ORDER_BYTES and anchor != rows[-1][0]:
                    yield flush()
                    rows, size = [], 0
                rows.append((anchor, zone, text))
                size += len(text)
        if rows:
            yield flush()

    return run


def factors_within(data: np.ndarray, sizes: list[int], groups: list[int], both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous (and, with ``both``, next) factor of each position
    of texts laid end to end, up to ``LENGTH``; a string that runs over a
    text's end, or whose equal lies in another group, does not count. The
    texts of a group are neighbours."""
    words, ranks = suffix_ranks(data)
    ends = np.repeat(np.cumsum(sizes), sizes)
    whole = np.flatnonzero(np.arange(len(data)) + LENGTH <= ends)
    group = np.repeat(np.cumsum(np.concatenate(([0], np.diff(np.array(groups)) != 0))), sizes)[whole]
    order = np.argsort((group.astype(np.uint64) << np.uint64(32)) | ranks[LENGTH][whole])
    at, group = whole[order], group[order]
    prefix = np.zeros(len(at), np.int64)
    prefix[1:] = np.where(group[1:] == group[:-1], common_prefixes(at[:-1], at[1:], words, ranks), 0)
    previous, following = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    previous[at] = factors(at, prefix)
    if both:
        following[at] = factors(-at, prefix)
    return previous, following


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            hashes, owner, offset = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                h = windows(np.frombuffer(text, np.uint8), [128])[128]
                n = len(text) - LENGTH + 1
                hashes.append(join(h[:n], h[LENGTH - 128:]))
                owner.append(np.full(n, i))
                offset.append(np.arange(n, dtype=np.int32))
            at = np.concatenate(owner)
            yield pa.record_batch([part.column("anchor").take(pa.array(at)), part.column("zone").take(pa.array(at)),
                                   pa.array(np.concatenate(offset)), pa.array(np.concatenate(hashes).astype(np.int64))],
                                  ["anchor", "zone", "off", "window"])


def repeated_spans(docs: DataFrame, keep: str = "none") -> DataFrame:
    """(doc_id, row, spans) of the documents that hold repeated windows;
    ``spans`` lists (at, n): ``n`` neighbouring windows from byte ``at`` are
    repeated. ``row`` is ``xxhash64(doc_id, text)``."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    first, rows = keep == "first", _rows(docs)
    listed = stage_table(rows.mapInArrow(_find_anchors, _ANCHORS), "anchors")
    again = stage_table(listed.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("c"))
                        .where("c > 1"), "again")
    each = listed.select("doc_id", "row", F.explode(F.arrays_zip("anchor", "zone", "at", "size")).alias("z")) \
        .select("doc_id", "row", "z.*")
    # an anchor may hold a third of all zones: the few of that kind are told where they are
    shared = stage_table(join_hot_split(each, again, "anchor", "c", HOT).drop("c"), "shared")
    place = F.struct("doc_id", "row", "at", "size")
    zones = stage_table(shared.groupBy("anchor", "zone").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("rep")),
                        "zones")
    crowds = zones.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    differing = zones.join(crowds, "anchor").select("anchor", "zone", "crowd", "rep.*")
    # doc_id is asked for so that this scan and shuffle of the texts is the one that ``remove`` reuses
    text = F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.col("size"))
    reps = differing.withColumnsRenamed({"doc_id": "rep_id", "row": "rep_row"})
    lettered = (rows.join(reps, (F.col("row") == F.col("rep_row")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
                .select("anchor", "zone", "crowd", "at", F.col("doc_id"), text.alias("text")))
    compared = (lettered.where(F.col("crowd") <= CROWD).repartition("anchor")
                .sortWithinPartitions("anchor", "doc_id", "at").select("doc_id", "anchor", "zone", "text")
                .mapInArrow(_compare(first), "anchor long, zone long, runs array<struct<at:int,n:int>>"))
    crowded = lettered.where(F.col("crowd") > CROWD).select("anchor", "zone", "text", "doc_id")
    hashed = crowded.mapInArrow(_window_hashes, "anchor long, zone long, off int, window long")
    counted = _crowd_runs(hashed, zones, first)
    whole = zones.where("copies > 1").select(
        "anchor", "zone", F.array(F.struct(F.lit(0).alias("at"), (F.col("rep.size") - LENGTH + 1).alias("n"))).alias("runs"))
    partly = compared.unionByName(counted)
    if first:
        is_rep = F.struct("doc_id", "row", "at", "size") == F.col("rep")
        found = (shared.join(zones.where("copies > 1").select("anchor", "zone", "rep"), ["anchor", "zone"])
                 .where(~is_rep).select("doc_id", "row", "at", F.array(F.struct(F.lit(0).alias("at"), (F.col("size") - LENGTH + 1).alias("n"))).alias("runs")))
        reps = zones.join(partly, ["anchor", "zone"]).select("rep.doc_id", "rep.row", "rep.at", "runs")
        found = found.unionByName(reps)
    else:
        marked = whole.unionByName(partly.join(zones.where("copies = 1").select("anchor", "zone"), ["anchor", "zone"]))
        found = shared.join(marked, ["anchor", "zone"]).select("doc_id", "row", "at", "runs")
    moved = found.select("doc_id", "row", F.expr("transform(runs, r -> struct(r.at + at as at, r.n as n))").alias("runs"))
    return moved.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def _crowd_runs(hashed: DataFrame, zones: DataFrame, first: bool) -> DataFrame:
    """The crowded anchors' repeated windows, each counted by its hash."""
    place = zones.select("anchor", "zone", F.struct("rep.doc_id", "rep.row", "rep.at").alias("place"))
    placed = hashed.join(place, ["anchor", "zone"]) if first else hashed.withColumn("place", F.lit(None).cast("long"))
    window = placed.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("least")).where("c > 1")
    hit = placed.join(window, ["anchor", "window"])
    hit = hit.where(F.col("place") != F.col("least")) if first else hit
    return hit.groupBy("anchor", "zone").agg(
        F.collect_list(F.struct(F.col("off").alias("at"), F.lit(1).alias("n"))).alias("runs"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()),
                        ("removed", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))])
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            out = []
            for doc_id, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                change = np.zeros(len(data) + 1, np.int64)
                for s in spans or ():
                    change[s["at"]] += 1
                    change[s["at"] + s["n"] + LENGTH - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                start, size = _runs(gone)
                out.append((doc_id, len(data), data[~gone].tobytes(),
                            [{"at": int(a), "n": int(n)} for a, n in zip(start, size, strict=True)]))
            yield pa.record_batch([pa.array([r[i] for r in out], schema[i].type) for i in range(4)], schema=schema)


def remove_repeats(docs: DataFrame, keep: str = "none") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, kept (the remaining
    bytes), removed (the maximal removed runs, at and n in bytes)."""
    rows = _rows(docs)
    spans = repeated_spans(docs, keep).withColumnsRenamed({"doc_id": "of_id", "row": "of_row"})
    return (rows.join(spans, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, removed array<struct<at:long,n:long>>"))


def removed_bytes(removed: Column) -> Column:
    """How many bytes the runs hold."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, r: n + r["n"])
