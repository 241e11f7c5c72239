"""Operator 1: byte-level BPE by longest match and backtracking.

Bytes are mapped to Latin-1 characters, so one pyahocorasick automaton over
the vocabulary finds every token that occurs in a piece. From left to right
the longest token that is *compatible* with its predecessor is taken; where
none is, the step before falls back to its next shorter prefix token.
Positions that failed once are not tried again, so a piece costs linear time.

Two tokens are compatible when merging their joined bytes by rank gives back
just these two. The answer is memoised per pair, and taken from the last merge
of each token: walking both merge trees down to the seam, a merge across the
seam must never come before a merge that one of the two tokens still needs.
A sequence whose neighbours are all compatible is the exact merge result.

Pieces come from the vocabulary's split pattern. Text between single blanks
splits the same way wherever it stands, so ids are cached per blank-separated
word (about ``CACHE_WORDS`` words per worker, the rare ones forgotten); text with other runs of
white space is split whole. Work is one ``mapInArrow`` pass per direction,
without a shuffle; a lost task is simply redone.

Defined results: a null or empty text has no ids and decodes to no bytes;
very long pieces are encoded in one pass; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, text_of

#: Words and pieces that a worker remembers (about 200 bytes each).
CACHE_WORDS, CACHE_PIECES = 200_000, 500_000
#: Bytes of ids in one output batch.
OUT_BYTES = 8_000_000


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {int(b): base64.b64decode(a) for a, b in pairs}


class Vocabulary:
    """The ranks of one file, with the encoder built on them."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.token = tokens(path)
        self.rank = {t: i for i, t in self.token.items()}
        self.split = regex.compile(pattern).findall
        # last merge of each token (None for a single byte); tokens that merging never reaches get no entry
        self.merge: dict[int, tuple[int, int] | None] = {}
        self._compatible = Memo(self._check_pair, 2_000_000)
        for i in sorted(self.token):
            parts = _merge_below(self.token[i], self.rank, i)
            if len(parts) == 1:
                self.merge[i] = None
            elif len(parts) == 2 and all(p in self.merge for p in parts):
                self.merge[i] = (parts[0], parts[1])
        self.automaton = ahocorasick.Automaton()
        for i in self.merge:
            self.automaton.add_word(self.token[i].decode("latin-1"), (i, len(self.token[i]) - 1))
        self.automaton.make_automaton()
        self.shorter = {i: self._prefix(self.token[i]) for i in self.merge}
        self.length = {i: len(t) for i, t in self.token.items()}
        self.piece_ids = Memo(self._encode_piece, CACHE_PIECES)
        self.word_ids = Memo(self._encode_word, CACHE_WORDS)

    def _prefix(self, token: bytes) -> int | None:
        """The longest proper prefix that is a token."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.rank.get(token[:n])) is not None and i in self.merge:
                return i
        return None

    def _check_pair(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        # ``due``: rank of the merge that takes the current left (right) part out of reach of the seam
        due_left = due_right = 1 << 62
        while True:
            seam = self.rank.get(self.token[left] + self.token[right])
            # ties cannot be: each rank is one string. A merge of equal rank goes leftmost first.
            if seam is not None and seam < due_left and seam <= due_right:
                return False
            a, b = self.merge[left], self.merge[right]
            if a is None and b is None:
                return True
            # undo the later of the two last merges: before it, its parts were there
            if b is None or (a is not None and left >= right):
                due_left, left = left, a[1]
            else:
                due_right, right = right, b[0]

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if data in self.rank:
            return [self.rank[data]]
        size, length, shorter, good = len(data), self.length, self.shorter, self._compatible
        longest: list[int | None] = [None] * (size + 1)
        for end, (i, before) in self.automaton.iter(data.decode("latin-1")):
            longest[end - before] = i  # ends ascend, so the last match of a start is its longest
        failed = bytearray(size + 1)
        ids: list[int] = []
        at, candidate = 0, longest[0]
        while at < size:
            while candidate is not None:
                if not failed[at + length[candidate]] and (not ids or good[ids[-1], candidate]):
                    break
                candidate = shorter[candidate]
            if candidate is None:
                failed[at] = 1
                last = ids.pop()
                at -= length[last]
                candidate = shorter[last]
            else:
                ids.append(candidate)
                at += length[candidate]
                candidate = longest[at]
        return ids

    def _encode_piece(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids := self.encode_bytes(piece.encode()))}I", *ids)

    def _encode_word(self, word: str) -> bytes | None:
        """Ids of a blank-separated word with its blank; None where the
        pattern could see past its ends."""
        body = word[1:]
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return b"".join(map(self.piece_ids.__getitem__, self.split(word)))

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, little-endian unsigned 32-bit."""
        first, *rest = text.split(" ")
        parts = [self.word_ids[" " + w] for w in rest]
        if not first or first[0].isspace() or first[-1].isspace() or None in parts:
            return b"".join(map(self.piece_ids.__getitem__, self.split(text)))
        return b"".join(map(self.piece_ids.__getitem__, self.split(first))) + b"".join(parts)


def _merge_below(data: bytes, rank: dict[bytes, int], limit: int) -> list[int]:
    """``data`` merged by all ranks under ``limit``, as ids."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min((rank.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(path, pattern)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, payload) rows as batches of bounded size."""
    keys, values, size = [], [], 0
    for key, value in rows:
        keys.append(key)
        values.append(value)
        size += len(value) + 16
        if size >= OUT_BYTES:
            yield pa.record_batch([pa.array(keys, schema[0].type), pa.array(values, schema[1].type)], schema=schema)
            keys, values, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, schema[0].type), pa.array(values, schema[1].type)], schema=schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ids (little-endian unsigned 32-bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path, pattern)
        rows = ((i.as_py(), encoder.encode(t.as_py())) for b in batches for i, t in zip(b.column("doc_id"), b.column("text"), strict=True))
        yield from _batches(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, ids, decoded (bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(path).__getitem__
        for batch in batches:
            step = max(1, int(batch.num_rows * OUT_BYTES / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column("ids")]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
