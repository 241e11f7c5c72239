"""Operator 8: sequence packing by power-of-two decomposition.

Each document is tokenised, ends with the separator id, and is cut into
pieces whose lengths are powers of two: as many pieces of ``LIMIT`` as fit,
then the binary expansion of the rest, longest first. Pieces of one length
form a bucket; a sequence is one piece, so it never crosses documents, needs
no padding (its length is a power of two) and batches from one bucket are
rectangular. Cutting is local to a document, so packing needs no shuffle, no
global state and no document's ids ever leave its row's task.

Tokenising is one ``mapInArrow`` pass over slices of bounded size. The
tokenizer never joins characters across white space, and takes letters and
punctuation apart. So a worker numbers the words it meets; the new ones of a
slice are tokenised together, as letter stems and tails, into one pool of ids,
and a text's ids are gathered from the pool by its words' numbers, without work
per word in Python. The pool is given up when it passes ``CACHE_BYTES``.
Special tokens in a text are what the library makes of them.

Defined results: a null or empty text is the separator alone; a document of
any length is cut whole; repeated rows are packed each, with sequence ids of
their own; ``sequence_id`` is unique and depends only on the input's
partitioning.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import runs, slices, text_of

#: Most ids in a sequence, the id that ends a document, and the id that pads.
LIMIT, SEPARATOR = 4096, 2
#: Bytes of words and ids that a worker remembers, about, and of one word besides its text.
CACHE_BYTES, WORD_BYTES = 100_000_000, 160
#: Characters of text that are tokenised together.
SLICE = 2_000_000

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: ASCII that the tokenizer does not count as white space, but Python does.
_CONTROL = re.compile("[\x1c-\x1f]").search


class Numbers(dict):
    """Words numbered in the order in which they are first asked for; ``fresh``
    lists the latest."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordTokenizer:
    """Ids of whole texts, gathered from the ids of their words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.folds = self._list("A Bc") == self._list("a bc")
        self._forget()

    def _forget(self) -> None:
        self.number, self.pool, self.bytes = Numbers(), np.empty(0, np.uint32), 0
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)  # of each word's ids in the pool

    def _list(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _words(self, text: str) -> list[str]:
        if any(t in text for t in self.special):
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if text.isascii() and not _CONTROL(text):
            return (text.lower() if self.folds and "<" not in text else text).split()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _stem_ids(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters only, each of which ends with its only
        word-ending token, from one pass over them all, and how many each has."""
        ids = np.array(self._list(" ".join(stems)), np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(stems):
            return ids, np.diff(ends, prepend=0)
        lists = [self._list(s) for s in stems]
        return np.array(list(chain.from_iterable(lists)), np.uint32), np.array([len(x) for x in lists], np.int64)

    def _learn(self) -> None:
        """The ids of the words numbered since the last time, and of their stems."""
        number, whole, halves, stems, alone = self.number, [], [], [], []
        base, fresh, number.fresh = len(self.size), number.fresh, []
        for i, word in enumerate(fresh):
            stem = word.rstrip(string.punctuation)
            if not stem.isalpha() or not (stem.isascii() or stem.lower().isalpha()):  # lower case may add a mark
                alone.append(i)
            elif len(stem) == len(word):
                stems.append(i)
            else:
                whole.append(i)
                halves += (number[stem], number[word[len(stem):]])
        more, number.fresh = number.fresh, []
        for i, word in enumerate(more, len(fresh)):
            (stems if word[0].isalpha() else alone).append(i)
        words = fresh + more
        ids, sizes = self._stem_ids([words[i] for i in stems]) if stems else (self.pool[:0], np.empty(0, np.int64))
        lists = [self._list(words[i]) for i in alone]
        self._put(base, len(words), stems, sizes, ids)
        self._put(base, len(words), alone, [len(x) for x in lists], np.array(list(chain.from_iterable(lists)), np.uint32))
        place, run = runs(self.first, self.size, np.array(halves, np.int64))
        self._put(base, len(words), whole, np.bincount(run // 2, minlength=len(whole)), self.pool[place])
        self.bytes += sum(map(len, words)) + len(words) * WORD_BYTES

    def _put(self, base: int, n: int, which: list[int], sizes, ids: np.ndarray) -> None:
        """Into the pool: the ids of ``which`` of the ``n`` words from ``base`` on."""
        grow = base + n - len(self.size)
        self.first, self.size = (np.concatenate((x, np.zeros(grow, np.int64))) for x in (self.first, self.size))
        sizes, which = np.asarray(sizes, np.int64), np.array(which, np.int64) + base
        self.first[which], self.size[which] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        self.pool = np.concatenate((self.pool, ids))
        self.bytes += 4 * len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if self.bytes > CACHE_BYTES:
            self._forget()
        split = [self._words(text) for text in texts]
        sizes = np.array([len(x) for x in split])
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.number.fresh:
            self._learn()
        place, _ = runs(self.first, self.size, words)
        upto = np.concatenate(([0], np.cumsum(self.size[words])))[np.cumsum(sizes)]
        return self.pool[place], np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and file."""
    return WordTokenizer(path)


def cuts(sizes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Which document, and length, of the pieces of documents of ``sizes``
    ids, in order; all lengths are powers of two."""
    full = sizes // limit
    owner, length = [np.repeat(np.arange(len(sizes)), full)], [np.full(int(full.sum()), limit)]
    bit = limit >> 1
    while bit:
        some = np.flatnonzero(sizes & bit)
        owner.append(some)
        length.append(np.full(len(some), bit))
        bit >>= 1
    owner, length = np.concatenate(owner), np.concatenate(length)
    order = np.argsort(owner, kind="stable")  # the longest pieces of a document come first already
    return owner[order], length[order]


def pack(docs: DataFrame, path: str, limit: int = LIMIT, separator: int = SEPARATOR) -> DataFrame:
    """``docs`` (doc_id, text) as pieces: doc_id, start, length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    ``limit`` must be a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for keys, texts in slices(batches, SLICE):
            ids, sizes = tokenizer.encode(texts)
            ids = np.insert(ids, np.cumsum(sizes), separator).astype("<u4")
            sizes = sizes + 1
            owner, length = cuts(sizes, limit)
            ends = np.cumsum(length)
            first = np.cumsum(sizes) - sizes  # of each document
            offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.record_batch([pa.array(keys, pa.int64()).take(pa.array(owner)), pa.array(ends - length - first[owner]), pa.array(length, pa.int64()),
                                   pieces, pa.array(sizes[owner])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _SCHEMA)
    return pieces.select("*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The packed sequences as one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)
