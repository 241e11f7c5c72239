"""Operators 11 and 12 against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import embedding_dedup, queries, va_clustering

SMALL = "/root/testdata/sf0.001"
ROW = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                    T.StructField("label", T.IntegerType())])
#: Extra columns whose names clash with what the operators make.
CLASH = {"cluster": "c", "row": 1, "kept": "k", "nid": 2, "a": 3, "v": 4, "copies": 5, "n_links": 6, "home": 7}


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW).coalesce(2)


def lloyd(rows, dim=64, k=8, rounds=10):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of the kept rows."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    v = np.array([x for _, x in kept], dtype=np.int64).reshape(-1, dim)
    first = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"3:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centroids = v[first[:k]].copy()
    for step in range(rounds + 1):
        distance = ((v[:, None] - centroids[None]) ** 2).sum(2)
        cluster = distance.argmin(1)
        for c in range(len(centroids)) if step < rounds else ():
            if (cluster == c).any():
                centroids[c] = v[cluster == c].sum(0) // (cluster == c).sum()
    d = distance.min(1)
    sums = np.bincount(cluster, d, len(centroids)).astype(int)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(((i, int(c), int(x), int(sums[c]), int(d.sum()), digest[c]) for (i, _), c, x in zip(kept, cluster, d, strict=True)), key=str)


def clustered(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                               va_clustering.centroid_digest(F.col("centroid")).alias("sha")).collect()), key=str)


def test_op11_query_equals_lloyd(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in queries.op11_va_file(spark, SMALL).collect()), key=str)
    assert got == lloyd(rows)


def test_op11_odd_rows(spark):
    draw = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=64)]) for i in range(60)]
    rows += [rows[0]] * 25 + [(None, rows[1][1]), (None, rows[2][1]), (7, rows[3][1])]  # repeats, null and repeated ids
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [math.nan] + [0.0] * 63),
             (105, [math.inf] + [0.0] * 63), (106, [None] + [0.0] * 63), (107, [0.0] * 64), (108, [60000.0] + [0.0] * 63)]
    df = frame(spark, [(*r, 0) for r in rows])
    assert clustered(va_clustering.cluster(df)) == lloyd(rows)
    assert clustered(va_clustering.cluster(df.withColumns({n: F.lit(x) for n, x in CLASH.items()}))) == lloyd(rows)


def test_op11_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(va_clustering.cluster(frame(spark, [(*r, None) for r in rows]))) == lloyd(rows)
    same = [(i, [0.5] * 64) for i in range(20)]  # equal centroids: the first takes all
    assert clustered(va_clustering.cluster(frame(spark, [(*r, None) for r in same]))) == lloyd(same)
    assert va_clustering.cluster(frame(spark, [])).collect() == []
    assert va_clustering.cluster(frame(spark, [(1, None, 1)])).collect() == []


def test_op11_huge_components_end_at_the_bound(spark):
    out = va_clustering.cluster(frame(spark, [(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [0.0] * 64, 0)]), k=1).collect()
    assert len(out) == 3 and max(abs(x) for x in out[0]["centroid"]) <= va_clustering.MOST


def test_intervals_hold_every_distance():
    draw = np.random.default_rng(5)
    v = (draw.normal(size=(500, 16)) * 400).astype(np.int64)
    marks = va_clustering.Cells(v.min(0), v.max(0), v[:60], v.mean(0).astype(np.int64))
    centroids = v[:8]
    table, own, k = marks.lookup(centroids)
    cells = marks.number(v)
    ends = own + sum(table[i][cells[:, i]] for i in range(16))
    w = v - marks.centre
    exact = ((v[:, None] - centroids) ** 2).sum(2) - (w * w).sum(1)[:, None]
    assert (ends[:, :k] <= exact).all() and (exact <= ends[:, k:]).all()
    told = marks.decide(cells, (table, own, k))
    sure = told >= 0
    assert sure.any() and (told[sure] == exact.argmin(1)[sure]).all()


def test_op11_fetches_only_where_intervals_overlap_or_clusters_change(spark):
    draw = np.random.default_rng(6)
    v = np.concatenate([draw.normal(size=(200, 64)) * .05 + c for c in draw.normal(size=(4, 64))])
    ints = va_clustering.integer_vectors(frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]), 64, 1024)
    n, low, high, centre = va_clustering._ranges(ints, 64)
    whole = np.array([r["v"] for r in ints.orderBy("vec_id").collect()], np.int64)
    marks = va_clustering.Cells(low, high, whole, centre)
    table = va_clustering._approximate(ints, marks)
    centroids = np.stack([whole[200 * c:200 * c + 200].mean(0).astype(np.int64) for c in range(4)])
    assert n == 800 and va_clustering.to_fetch(table, marks, centroids, centroids).count() == 0
    other = centroids[[1, 0, 2, 3]]  # two clusters change names: just their vectors move
    assert va_clustering.to_fetch(table, marks, centroids, other).count() == 400


def linked(rows, share=0.93):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None
            for _, v, label in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if good[i] and good[j] and label == rows[j][2] and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= share:
                    links[i] += 1
                    links[j] += 1
                    a, b = root[i], root[j]
                    root = [a if r == b else r for r in root]
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return sorted((i, n, least[r], i == least[r]) for (i, _, _), n, r in zip(rows, links, root, strict=True))


def near(df):
    return sorted(tuple(r) for r in embedding_dedup.near_vectors(df).collect())


def noisy(seed, groups, each, dim=64):
    """Vectors about shared bases, at cosines on both sides of 0.93."""
    draw = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = draw.normal(size=dim)
        for _ in range(each):
            size = draw.uniform(0, .35) * np.linalg.norm(base) / math.sqrt(dim)
            out.append((len(out), [float(x) for x in (base + draw.normal(size=dim) * size).astype(np.float32)], g % 3))
    return out


def test_op12_query_on_a_table(spark, tmp_path):
    rows = noisy(12, 12, 9) + noisy(13, 1, 40)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op12_product_quantisation(spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in out.collect()) == linked(rows)


def test_op12_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = noisy(14, 3, 60)
    assert near(frame(spark, rows)) == linked(rows)


def test_op12_odd_rows(spark):
    rows = noisy(15, 4, 5)
    v = rows[0][1]
    rows += [(20 + i, v, 0) for i in range(30)]  # exact copies
    rows += [(60, [2 * x for x in v], 0), (61, v, 1), (62, v, None), (63, None, 0), (64, [], 0), (65, [0.0] * 64, 0), (66, [0.0] * 64, 0),
             (67, [math.nan, *v[1:]], 0), (68, [math.inf, *v[1:]], 0), (69, [None, *v[1:]], 0), (70, v[:10], 0), (71, v[:10], 0),
             (72, [1e30] * 64, 0), (73, [3e37] * 64, 0), (1, rows[9][1], 0)]
    df = frame(spark, rows)
    assert near(df) == linked(rows)
    assert near(df.withColumns({n: F.lit(x) for n, x in CLASH.items()})) == linked(rows)


def test_op12_null_ids_and_no_rows(spark):
    v = noisy(16, 1, 1)[0][1]
    out = embedding_dedup.near_vectors(frame(spark, [(None, v, 0), (5, v, 0), (6, [-x for x in v], 0), (None, None, 0)])).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == [
        (5, 1, None), (6, 0, 6), (None, 0, None), (None, 1, None)]
    assert near(frame(spark, [])) == []
    assert near(frame(spark, [(1, None, 0), (2, v, None)])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_code_bounds_lose_no_link():
    """A linked vector's look-up estimate never falls below the code's bound."""
    rows = [np.array(v) for _, v, _ in noisy(17, 80, 8)]
    u = embedding_dedup.unit(np.array(rows), 64)
    index = embedding_dedup.fit(u.astype(np.float32), 16, 0.93)
    home, code, bound, _, _ = embedding_dedup.entries(index, u)
    stored = index.centroids[home] + np.concatenate([index.words[m][code[:, m]] for m in range(embedding_dedup.PARTS)], 1)
    pairs = (u @ u.T) >= 0.93
    assert pairs.sum() > 2000 and ((u @ stored.T)[pairs] >= np.broadcast_to(bound, pairs.shape)[pairs]).all()


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_op12_refuses_a_useless_threshold(spark, share):
    with pytest.raises(ValueError):
        embedding_dedup.near_vectors(frame(spark, []), share)
