"""Operator 13 against a token-by-token alignment."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries, token_alignment

A, B = queries.BYTE_BPE_JSON, queries.PIECE_BPE
TEXTS = [None, "", " ", "\n", "a", "The quick brown fox", " two  blanks\n\nand\tlines ", "a ▁ b", "▁", "x" * 5000, "日本語のテキスト and é",
         "<|endoftext|> <s> </s> <unk> <0x41>", "😀" * 200, "don't we'll I'm", "snowboarding uncharacteristically 3.14159e-10", "end\n next", "  odd blanks \u0085",
         "null\x00byte", "The quick brown fox", "word " * 3000, "é ﬁ Å", "trailing ", "a\r\nb"]


def reference(texts):
    """Per text the seven figures and its digest."""
    ranks = {int(i): base64.b64decode(t) for t, i in (line.split() for line in open(queries.BYTE_BPE, "rb"))}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for text in texts:
        groups = []
        if text:
            ta = [(i, ranks[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, raw_b(i)) for i in b.encode(text)]
            if b"".join(t for _, t in ta) == b"".join(t for _, t in tb) == (" " + text).encode():
                while ta:
                    x, y = [ta.pop(0)], [tb.pop(0)]
                    while (n := sum(len(t) for _, t in x)) != (m := sum(len(t) for _, t in y)):
                        (x if n < m else y).append((ta if n < m else tb).pop(0))
                    groups.append(([i for i, _ in x], [i for i, _ in y]))
        rows.append(groups)
    links = [Counter((p, q) for x, y in groups for p in x for q in y) for groups in rows]
    count = Counter(pair for c in links for pair in c)
    most = Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for groups, c in zip(rows, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out, {p: (n, n == most[p[0]]) for p, n in count.items()}


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [200_000, 3])  # 3: nearly all pairs go through the join
def test_alignment_equals_reference(spark, wide, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    rows = list(enumerate(TEXTS)) + [(None, "no id here"), (3, "repeated id")]
    want, pairs = reference([t for _, t in rows])
    documents, links = token_alignment.align(wide(rows), A, B)
    got = sorted((str(r["doc_id"]), *(r[c] for c in FIGURES)) for r in documents.collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in links.collect()} == pairs


def test_query_equals_reference_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, _ = reference([r["text"] for r in docs])
    out = queries.op13_token_alignment(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", *FIGURES]
    assert sorted(tuple(r) for r in out.collect()) == sorted((r["doc_id"], *w) for r, w in zip(docs, want, strict=True))


def test_empty_table(spark, docs):
    documents, links = token_alignment.align(docs([]), A, B)
    assert documents.collect() == [] and links.collect() == []


def test_whole_texts_where_a_model_could_join_across_blanks():
    both = token_alignment.Aligner(A, B)
    cut = both.align([1, 2], ["one two  three\nfour five", "so so so"])
    both.separable = False
    assert both.align([1, 2], ["one two  three\nfour five", "so so so"]) == cut
