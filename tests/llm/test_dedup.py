"""Exact, near and substring deduplication against brute force."""
import random
import re

import numpy as np
import pytest

from tidemark.llm import exact_dedup, near_dedup, queries, substring_dedup
from tidemark.llm.components import components


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_exact_groups(wide, odd):
    out = exact_dedup.exact_groups(wide(odd), digest_all=True).collect()
    assert len(out) == len(odd) and all(r.digest for r in out)
    by = {r.doc_id: r for r in out if r.doc_id not in (1, 2, 3, 7)}
    blank = [r for r in out if r.doc_id in (1, 2, 3)]
    assert {r.keep_id for r in blank} == {3} and {r.group_size for r in blank} == {3} and sum(r.kept for r in blank) == 1
    same = [r for r in out if r.doc_id in (6, 7)]
    assert [r.keep_id for r in same] == [6, 6, 6] and [r.doc_id for r in same if r.kept] == [6]
    assert all(by[i].kept and by[i].group_size == 1 and by[i].keep_id == i for i in (4, 5, 8, 9, 10, None))


def test_exact_prefers_the_longest_original_then_the_least_id(docs):
    out = exact_dedup.exact_groups(docs([(5, "ab"), (3, "a b"), (2, "a b"), (9, "a\tb"), (4, "abc")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in out} == {(5, 2, False), (3, 2, False), (2, 2, True), (9, 2, False), (4, 4, True)}


def test_exact_prefix_survives_leading_blanks(docs):
    tail = "".join(chr(97 + i % 26) for i in range(300))
    out = exact_dedup.exact_groups(docs([(1, "a" + " " * 600 + tail), (2, "a" + tail), (3, "a" + tail + "!")])).collect()
    assert {(r.doc_id, r.keep_id) for r in out} == {(1, 1), (2, 1), (3, 3)}


def test_exact_drop_keeps_columns_and_one_row(wide, odd):
    kept = exact_dedup.drop_exact_copies(wide(odd + [(6, "Same text here")]))
    assert kept.columns == ["doc_id", "text", "n_chars", "kept", "row", "ids"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9, 10]
    assert exact_dedup.drop_exact_copies(wide([])).collect() == []


def brute_near(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_near_components_equal_brute_force(docs, width, num, monkeypatch):
    r = random.Random(width)
    rows, bases = [], [words(r, n) for n in (6, 30, 120, 400)]
    for base in bases:
        for _ in range(30):
            copy = list(base)
            for _ in range(r.randrange(1 + len(copy) // 12)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "one two", "one two!", " ".join(words(r, 50))])]
    got = {tuple(x) for x in near_dedup.near_duplicates(docs(rows), width, num, 100).collect()}
    assert got == brute_near(rows, width, num, 100)


def test_near_small_blocks_and_regions_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "REGION", 5)
    r = random.Random(4)
    base = words(r, 150)
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(150)] = f"e{i}_{r.random()}"
        rows.append((i, " ".join(copy)))
    assert {tuple(x) for x in near_dedup.near_duplicates(docs(rows), 3, 85, 100).collect()} == brute_near(rows, 3, 85, 100)


def test_near_odd_rows(wide, odd):
    out = near_dedup.near_duplicates(wide(odd)).collect()
    assert len(out) == len(odd)
    assert {(r.doc_id, r.component_id, r.kept) for r in out if r.doc_id in (1, 2, 6, 7, None)} == {
        (1, 1, True), (2, 2, True), (6, 6, True), (7, 6, False), (None, None, True)}
    kept = near_dedup.drop_near_copies(wide(odd))
    assert kept.columns == ["doc_id", "text", "n_chars", "kept", "row", "ids"] and kept.count() == len(odd) - 2
    assert near_dedup.near_duplicates(wide([])).collect() == []


def test_near_repeated_and_null_ids_with_different_texts(wide):
    """Of rows with one id, near copies of others go and unique texts stay."""
    r = random.Random(9)
    rows, unique = [], set()
    for i in (1, 2, 3, 4, 5, None):
        base = words(r, 80)
        own = " ".join(words(r, 80))
        near = [*base[:40], "changed", *base[41:]]
        rows += [((i or 0) + 100, " ".join(base)), (i, own), (i, " ".join(near))]
        unique |= {(i, own)} | ({(i, " ".join(near))} if i is None or i < 100 else set())
    kept = {(x.doc_id, x.text) for x in near_dedup.drop_near_copies(wide(rows)).collect()}
    assert kept == unique


def test_near_crowded_regions_go_deeper(docs, monkeypatch):
    """Many texts about one template, most of them not alike: regions crowd at
    depth three, and links are still those of all pairs."""
    monkeypatch.setattr(near_dedup, "REGION", 4)
    r = random.Random(12)
    template = words(r, 120)
    rows = [(i, " ".join([*template[:100 - i % 40], *words(r, 20 + i % 40, 10 ** 6)])) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows]
    assert {tuple(x) for x in near_dedup.near_duplicates(docs(rows), 3, 85, 100).collect()} == brute_near(rows, 3, 85, 100)


def test_op3_query_on_a_whole_table(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(x) for x in queries.op3_minhash_forest(spark, "/root/testdata/sf0.001").collect()} == brute_near(rows, 3, 85, 100)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    out = {tuple(r) for r in components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect()}
    assert out == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


def brute_repeats(rows, keep):
    seen = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        data = (t or "").encode()
        for p in range(len(data) - 199):
            seen.setdefault(data[p:p + 200], []).append((i, p))
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for p in range(len(data) - 199):
            places = seen[data[p:p + 200]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, p)):
                gone[p] += 1
                gone[p + 200] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        out[i] = bytes(np.frombuffer(data, np.uint8)[~covered])
    return out


def repeat_rows():
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, long = text(260), text(900)
    rows = [(i, text(r.randrange(400)) + passage[r.randrange(30):] + text(r.randrange(300))) for i in range(12)]
    rows += [(20, long), (21, long), (22, text(50) + long[100:500] + text(10)), (23, "a" * 700), (24, "ab" * 300), (25, "short"),
             (26, None), (27, ""), (28, long[:199]), (29, text(150) + "xy" * 150 + text(20))]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [10_000, 1])
def test_repeats_equal_brute_force(docs, keep, crowd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rows = repeat_rows()
    out = {r.doc_id: bytes(r.kept) for r in substring_dedup.remove_repeats(docs(rows), keep).collect()}
    assert out == brute_repeats(rows, keep)


def test_repeats_odd_rows(wide, odd):
    out = substring_dedup.remove_repeats(wide(odd)).collect()
    assert len(out) == len(odd)
    gone = {r.doc_id: sum(x.n for x in r.removed) for r in out}
    assert gone[8] == 25_000 and gone[9] == 20_000 and gone[1] == gone[2] == gone[10] == 0
    assert substring_dedup.remove_repeats(wide([])).collect() == []


def test_slices_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 300)
    data = np.frombuffer("".join(random.Random(1).choice("abc") for _ in range(2000)).encode(), np.uint8)
    parts = substring_dedup.anchors(data)
    assert sorted(sum(([int(a) + i for i in range(int(n) - 199)] for a, n in zip(parts[2], parts[3])), [])) == list(range(1801))


def test_factors_equal_brute_force():
    """Lengths of the longest previous and next factors, group by group."""
    rng = np.random.default_rng(4)
    for case in range(12):
        base, texts = rng.integers(97, 99, 400).astype(np.uint8), []
        for _ in range(int(rng.integers(1, 6))):
            n, at, m = int(rng.integers(200, 300)), int(rng.integers(0, 100)), int(rng.integers(0, 200))
            text = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
            text[:m] = base[at:at + m]
            texts.append(text)
        sizes, groups = [len(t) for t in texts], [i // 2 if case % 2 else 7 for i in range(len(texts))]
        data = np.concatenate(texts)
        previous, following = substring_dedup.factors_within(data, sizes, groups)
        begin = np.cumsum([0, *sizes])
        places = [(int(begin[i]) + j, g) for i, g in enumerate(groups) for j in range(sizes[i] - 199)]
        for p, g in places[::7]:
            likeness = {q: next((k for k in range(200) if data[p + k] != data[q + k]), 200) for q, h in places if h == g and q != p}
            assert previous[p] == max((n for q, n in likeness.items() if q < p), default=0)
            assert following[p] == max((n for q, n in likeness.items() if q > p), default=0)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_with_hot_anchors_and_null_ids(docs, keep, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rows = repeat_rows()
    out = {r.doc_id: bytes(r.kept) for r in substring_dedup.remove_repeats(docs(rows), keep).collect()}
    assert out == brute_repeats(rows, keep)
    same = [(None, rows[12][1]), (None, rows[12][1][:300]), (5, "unique " * 5)]
    got = sorted((r.n_bytes, len(r.kept)) for r in substring_dedup.remove_repeats(docs(same)).collect())
    sizes = [len(t.encode()) for _, t in same]
    assert got == sorted([(sizes[0], sizes[0] - sizes[1]), (sizes[1], 0), (sizes[2], sizes[2])])
