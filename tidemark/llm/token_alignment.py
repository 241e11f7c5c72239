"""Operator 13: alignment of two tokenizers' tokens over a corpus.

A text's tokens under A (byte-level BPE) and B (pieces with byte fallback)
cover the same bytes. Offsets at which tokens of both end cut them into
groups; every A token of a group is linked with every B token of it, and the
count of an id pair is the number of documents that hold it linked.

* **Identity map.** A's ids have an array of the B id with the same bytes. A
  group of one token each whose B id is that id needs no pair: the document
  keeps the A id, and such pairs are counted in a vector as long as A's
  vocabulary.
* **Irregular pairs.** Only other groups give pairs. A group's links are
  multiplied out per distinct id, not per occurrence, and a document keeps each
  distinct pair with its number of links. Pairs are counted by an aggregation
  that combines before it shuffles.
* **Scores.** A document's links are scored by the vectors (identity pairs'
  counts, each A id's highest count), by a table of the most frequent pairs
  (at most ``FREQUENT`` rows, whatever the corpus), and, for the pairs left
  over, by a join on the pair. No pair of that join is frequent, so none is hot.

Each text is read once. At a blank between two characters that are not white
space a token of both begins, so texts are cut there and each distinct segment
of a slice is tokenised and aligned once (a B model with pieces across such
blanks, or that rewrites characters, gets whole texts). What a document keeps
is staged as arrays.

Defined results: texts that are null, empty, or whose joined A or B bytes are
not the blank and the text (B replaces U+2581, say) have no tokens; special
strings are plain text; repeated rows are documents each; an empty table gives
an empty one; texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import runs, slices, text_of
from tidemark.session import stage_table

#: Most rows of the table of frequent pairs (16 bytes each).
FREQUENT = 200_000
#: Characters whose distinct segments are tokenised once, and segments tokenised in a call.
SLICE, BATCH = 3_000_000, 5_000

_CUT = re.compile(r"(?<=\S) (?=\S)").split

_KEPT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "same array<int>, same_links array<long>, pairs array<long>, pair_links array<long>")


def byte_level_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes for U+0100 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_level_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        first = {t: i for i, t in reversed(list(enumerate(self.bytes_b)))}  # the smallest id, where bytes repeat
        self.same = np.array([first.get(t, -1) for t in self.bytes_a], np.int64)
        # no piece goes on from a character to a blank, nor changes one on the way: texts may be cut there
        self.separable = (not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.size_b))
                          and b"\n\x08identity" in self.b.serialized_model_proto())
        # decimal ids with each sign that may follow them
        self.words = ([f"{i}{sign}".encode() for sign in ",|" for i in range(self.size_a)]
                      + [f"{i}{sign}".encode() for sign in (",", ";", "") for i in range(self.size_b)])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """Parts that tokenise alike wherever they stand: a blank between two
        characters that are not white space begins a token of both."""
        if not text:
            return []
        return _CUT(text) if self.separable else [text]

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text, or None where they do not cover it."""
        ids_a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text)
        raw = b" " + text.encode()
        if raw != b"".join(map(self.bytes_a.__getitem__, ids_a)) or raw != b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of segments joined by blanks, and how many of them each has;
        None where they do not cover it or do not break at the blanks."""
        ids = self._ids(" ".join(texts))
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        if ids is None:
            return None
        count = []
        for part, length in zip(ids, (self.length_a, self.length_b), strict=True):
            reach = np.cumsum(length[part])
            upto = np.searchsorted(reach, ends)
            if (reach[upto] != ends).any():
                return None
            count.append(np.diff(upto, prepend=-1))
        return *ids, *count

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Places of the texts that both tokenizers cover, all their ids, and
        how many of them each text has. Texts that begin and end with other
        than white space are tokenised together."""
        plain = [i for i, t in enumerate(texts) if self.separable and not (t[0].isspace() or t[-1].isspace() or "▁" in t)]
        alone = [[i] for i in sorted(set(range(len(texts))).difference(plain))]
        found = []
        for group in [plain[at:at + BATCH] for at in range(0, len(plain), BATCH)] + alone:
            ids = self._together([texts[i] for i in group])
            if ids is not None:
                found.append((group, *ids))
            elif len(group) > 1:
                alone = [(i, self._together([texts[i]])) for i in group]
                found += [([i], *ids) for i, ids in alone if ids is not None]
        return tuple(np.concatenate([np.array(x[k], np.int64) for x in found]) if found else np.empty(0, np.int64)
                     for k in range(5))

    def _written(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Each text's groups, written out; ``last``: the number of each text's
        last group."""
        more_a = np.append(ga[1:] == ga[:-1], False)
        more_b = np.append(gb[1:] == gb[:-1], False)
        ends = np.isin(gb, last)
        word_a = a + np.where(more_a, 0, self.size_a)
        word_b = 2 * self.size_a + b + np.where(more_b, 0, np.where(ends, 2, 1) * self.size_b)
        order = np.argsort(np.concatenate((2 * ga, 2 * gb + 1)), kind="stable")
        words = np.concatenate((word_a, word_b))[order]
        cut = np.concatenate(([0], np.searchsorted(ga, last, "right") + np.searchsorted(gb, last, "right"))).tolist()
        words = [self.words[i] for i in words.tolist()]
        return [b"".join(words[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]

    def table(self, texts: list[str]) -> "Segments":
        """Groups and links of some segments."""
        n = len(texts)
        at, a, b, size_a, size_b = self._encode(texts)
        good = np.zeros(n, bool)
        good[at] = True
        count = np.zeros((4, n), np.int64)  # n_a, n_b, n_groups, n_links
        count[0, at], count[1, at] = size_a, size_b
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        seam = np.intersect1d(end_a, end_b, assume_unique=True)
        ga, gb = np.searchsorted(seam, end_a), np.searchsorted(seam, end_b)
        na, nb = np.bincount(ga, minlength=len(seam)), np.bincount(gb, minlength=len(seam))
        last = ga[np.cumsum(size_a) - 1]  # tokens of both end with the text
        owner = at[np.searchsorted(last, np.arange(len(seam)))]
        count[2] = np.bincount(owner, minlength=n)
        np.add.at(count[3], owner, na * nb)
        written = [b""] * n
        for i, value in zip(at.tolist(), self._written(a, ga, b, gb, last), strict=True):
            written[i] = value

        single = (na == 1) & (nb == 1)
        fast_a, fast_b, fast_owner = a[single[ga]], b[single[gb]], owner[single]
        equal = self.same[fast_a] == fast_b
        odd = ~single
        odd[np.flatnonzero(single)[~equal]] = True
        (of, x, y), links = self._pairs(a[odd[ga]], ga[odd[ga]], b[odd[gb]], gb[odd[gb]], owner)
        # identity pairs within other groups count with the identity pairs
        known = self.same[x] == y
        same_of = np.concatenate((fast_owner[equal], of[known]))
        order = np.argsort(same_of, kind="stable")
        same, same_links = (np.concatenate(v)[order] for v in ((fast_a[equal], x[known]), (np.ones(int(equal.sum()), np.int64), links[known])))
        edges = np.arange(n + 1)
        return Segments(good, count, written, np.searchsorted(same_of[order], edges), same, same_links,
                        np.searchsorted(of[~known], edges), x[~known] * self.size_b + y[~known], links[~known])

    def align(self, keys: list, texts: list[str]) -> pa.RecordBatch:
        """What each document keeps; see ``_KEPT``."""
        n = len(texts)
        split = [self.segments(t) for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        parts = list(chain.from_iterable(split))
        number = {part: i for i, part in enumerate(dict.fromkeys(parts))}
        segments = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        owner, table = np.repeat(np.arange(n), sizes), self.table(list(number))
        good = np.ones(n, bool)
        good[owner[~table.good[segments]]] = False
        segments, owner = segments[good[owner]], owner[good[owner]]
        count = [np.bincount(owner, c[segments], n).astype(np.int64) for c in table.count]
        digest, edges = [""] * n, np.searchsorted(owner, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            groups = map(table.written.__getitem__, segments[edges[i]:edges[i + 1]].tolist())
            digest[i] = hashlib.sha256(b";".join(groups)).hexdigest()
        columns = [pa.array(keys, pa.int64()), *map(pa.array, count), pa.array(digest, pa.string())]
        for at, values, links, most, kind in ((table.same_at, table.same, table.same_links, self.size_a, np.int32),
                                              (table.pair_at, table.pairs, table.pair_links, self.size_a * self.size_b, np.int64)):
            place, run = runs(at[:-1], np.diff(at), segments)
            key, total = _summed(owner[run] * most + values[place], links[place])
            offsets = pa.array(np.searchsorted(key // most, np.arange(n + 1)).astype(np.int32))
            columns += [pa.ListArray.from_arrays(offsets, pa.array((key % most).astype(kind))), pa.ListArray.from_arrays(offsets, pa.array(total))]
        return pa.record_batch(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_links", "pairs", "pair_links"])

    def _pairs(self, a, ga, b, gb, owner):
        """((document, A id, B id), links) of some groups, ascending."""
        key_a, times_a = np.unique(ga * self.size_a + a, return_counts=True)
        key_b, times_b = np.unique(gb * self.size_b + b, return_counts=True)
        of_a, of_b = key_a // self.size_a, key_b // self.size_b
        first, end = np.searchsorted(of_b, of_a), np.searchsorted(of_b, of_a, "right")
        size = end - first
        left = np.repeat(np.arange(len(key_a)), size)
        right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        x, y, at = key_a[left] % self.size_a, key_b[right] % self.size_b, owner[of_a[left]] if len(left) else left
        pair, links = _summed((at * self.size_a + x) * self.size_b + y, times_a[left] * times_b[right])
        return (pair // (self.size_a * self.size_b), pair // self.size_b % self.size_a, pair % self.size_b), links


class Segments(NamedTuple):
    """Distinct segments: whether both tokenizers cover them; their counts and
    groups written out; runs of identity pairs and of others, with links."""

    good: np.ndarray
    count: np.ndarray
    written: list[bytes]
    same_at: np.ndarray
    same: np.ndarray
    same_links: np.ndarray
    pair_at: np.ndarray
    pairs: np.ndarray
    pair_links: np.ndarray


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    keys, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, where, values)
    return keys, out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker and pair of files."""
    return Aligner(path_a, path_b)


def kept(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """What each document keeps: its figures, the A ids of its identity pairs
    and its other pairs (A id * B's size + B id), each with its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for keys, texts in slices(batches, SLICE):
            yield both.align(keys, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _KEPT)


def same_counts(rows: DataFrame, size_a: int) -> np.ndarray:
    """Documents that hold each A id linked with its same-bytes B id: one
    vector per task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_a, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("same").flatten().to_numpy(), minlength=size_a)
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["a", "n"])

    out = np.zeros(size_a, np.int64)
    for a, n in rows.select("same").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n")).collect():
        out[a] = n
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): documents that hold each irregular pair linked."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _threshold(counts: DataFrame) -> int:
    """The least power of two that at most ``FREQUENT`` counts reach."""
    power = F.length(F.conv(F.col("n").cast("string"), 10, 2)) - 1
    total = 0
    for p, n in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1))).orderBy(F.desc("power")).collect():
        total += n
        if total > FREQUENT:
            return 1 << (p + 1)
    return 1


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``."""
    total, end = np.concatenate(([0], np.cumsum(values))), np.cumsum(sizes)
    return total[end] - total[end - sizes]


def _scored(rows: DataFrame, same: np.ndarray, highest: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, size_b: int) -> DataFrame:
    """(row, n_best, count_sum, rest, rest_links): what the vectors and the
    table of frequent pairs tell, and the pairs left over."""
    best_same, best_pair = same == highest, pair_n == highest[pairs // size_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links = (batch.column(c).flatten().to_numpy() for c in ("same", "same_links"))
            sizes = pc.list_value_length(batch.column("same")).to_numpy()
            key, key_links = (batch.column(c).flatten().to_numpy() for c in ("pairs", "pair_links"))
            key_sizes = pc.list_value_length(batch.column("pairs")).to_numpy()
            at = np.searchsorted(pairs, key)
            found = np.zeros(len(key), bool)
            if len(pairs):
                at = np.minimum(at, len(pairs) - 1)
                found = pairs[at] == key
                value, best = np.where(found, pair_n[at], 0), found & best_pair[at]
            else:
                value, best = np.zeros(len(key), np.int64), found
            left = np.concatenate(([0], np.cumsum(_sums((~found).astype(np.int64), key_sizes)))).astype(np.int32)
            yield pa.record_batch(
                [batch.column("row"), pa.array(_sums(links * best_same[ids], sizes) + _sums(key_links * best, key_sizes)),
                 pa.array(_sums(links * same[ids], sizes) + _sums(key_links * value, key_sizes)),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(key[~found])),
                 pa.ListArray.from_arrays(pa.array(left), pa.array(key_links[~found]))],
                ["row", "n_best", "count_sum", "rest", "rest_links"])

    return rows.select("row", "same", "same_links", "pairs", "pair_links").mapInArrow(
        run, "row long, n_best long, count_sum long, rest array<long>, rest_links array<long>")


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) as (documents, links).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256; links: a, b, n (documents that hold them linked), best."""
    spark = docs.sparkSession
    both = aligner(path_a, path_b)
    rows = stage_table(kept(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    same = same_counts(rows, both.size_a)
    counts = stage_table(pair_counts(rows), "pairs")
    a_of = F.expr(f"CAST(pair DIV {both.size_b} AS INT)")
    highest = same.copy()  # one number per A id
    for a, n in counts.groupBy(a_of.alias("a")).agg(F.max("n")).collect():
        highest[a] = max(highest[a], n)
    least = _threshold(counts)
    top = sorted(tuple(r) for r in counts.where(F.col("n") >= least).select("pair", "n").collect())  # FREQUENT rows at most
    pairs, pair_n = np.array([p for p, _ in top], np.int64), np.array([n for _, n in top], np.int64)
    scored = stage_table(_scored(rows, same, highest, pairs, pair_n, both.size_b), "scored")
    most = spark.createDataFrame([(int(i), int(highest[i])) for i in np.flatnonzero(highest)], "a int, highest long")
    marked = counts.withColumn("a", a_of).join(F.broadcast(most), "a").withColumn("best", F.col("n") == F.col("highest"))
    rest = scored.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_links")).alias("r")).select(
        "row", F.col("r.rest").alias("pair"), F.col("r.rest_links").alias("links"))
    rare = (rest.join(marked.where(F.col("n") < least).select("pair", "n", "best"), "pair").groupBy("row")
            .agg(F.sum(F.col("links") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best")))
    known = scored.select("row", "n_best", "count_sum").join(rare, "row", "left")
    documents = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(known, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
    equal = spark.createDataFrame([(int(a), int(both.same[a]), int(same[a]), bool(same[a] == highest[a])) for a in np.flatnonzero(same)],
                                  "a int, b int, n long, best boolean")
    links = equal.unionByName(marked.select("a", F.expr(f"CAST(pair % {both.size_b} AS INT)").alias("b"), "n", "best"))
    return documents, links
