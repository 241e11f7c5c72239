"""Byte-level BPE against tiktoken, packing against the tokenizer."""
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing, queries

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
PIECES = ["the", "er", "an", " ", "  ", "\n", "é", "é", "ß", "Σ", "9", "12", "!!", "'s", "don't", "日本", "\U0001f600", "\x1c", "　", "İ", "_", "<|endoftext|>"]


def made(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["x" * 5000, " " * 3000, "ab" * 4000]


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in byte_bpe.tokens(RANKS).items()}, special_tokens={})


def test_encoding_equals_the_library(reference):
    own = byte_bpe.vocabulary(RANKS, P.PATTERN)
    for text in made(4000, 1):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_encode_and_decode_on_odd_rows(wide, odd, reference):
    out = byte_bpe.decode(byte_bpe.encode(wide(odd), RANKS, P.PATTERN), RANKS).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()) for r in out)
    want = sorted((i if i is not None else -1, t or "", reference.encode_ordinary(t or "")) for i, t in odd)
    assert got == want


def test_empty_table(docs):
    assert byte_bpe.decode(byte_bpe.encode(docs([]), RANKS, P.PATTERN), RANKS).collect() == []
    assert packing.pack(docs([]), WORDS).collect() == []


def test_forgetful_caches_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 8)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 8)
    own = byte_bpe.Vocabulary(RANKS, P.PATTERN)
    for text in made(200, 2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def library(text):
    """The ids of the tokenizer as it is loaded from its file."""
    return Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    own, fresh = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = made(3000, 3) + ["a <|endoftext|> b", "<|ENDOFTEXT|> Ab", "x<|startoftext|>Y", "A\x0bB\x0cC", "a\x1cb \x1f"]
    for i in range(0, len(texts), 37):
        part = texts[i:i + 37]
        ids, sizes = own.encode(part)
        want = [fresh.encode(t, add_special_tokens=False).ids for t in part]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_cuts_are_powers_of_two_and_cover():
    sizes = np.array([1, 2, 0, 3, 4095, 4096, 4097, 12345])
    owner, length = packing.cuts(sizes, 4096)
    assert np.bincount(owner, length, len(sizes)).tolist() == sizes.tolist() and (np.diff(owner) >= 0).all()
    assert all(k & (k - 1) == 0 and k <= 4096 for k in length.tolist())
    assert all((np.diff(length[owner == i]) <= 0).all() for i in range(len(sizes)))


def expected(rows):
    """(doc_id, doc_tokens, start, length, ids) of the pieces, cut one by one."""
    out = []
    for i, text in rows:
        ids = [*library(text or ""), packing.SEPARATOR]
        at = 0
        while at < len(ids):
            k = min(packing.LIMIT, 1 << (len(ids) - at).bit_length() - 1)
            out.append((-1 if i is None else i, len(ids), at, k, np.array(ids[at:at + k], "<u4").tobytes()))
            at += k
    return sorted(out)


def test_packing_keeps_every_id_once(wide, odd):
    rows = [*odd, (11, "a <|endoftext|> b")]
    out = packing.pack(wide(rows), WORDS).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and r.bucket == r.length for r in out)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.doc_tokens, r.start, r.length, bytes(r.ids)) for r in out) == expected(rows)


def test_op8_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op8_pack_power_of_two(spark, "/root/testdata/sf0.001").collect()
    got = sorted((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in out)
    assert got == sorted((i, n, at, k, zlib.crc32(ids)) for i, n, at, k, ids in expected(rows))


def test_limit_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs([]), WORDS, limit=100)
