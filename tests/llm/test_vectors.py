"""Neighbour search and embedding classes against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import kmeans_tree, rotation_codes
from arealis.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, id string, v string, leaf string, key string"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "x", "x", "x") for i, v, l in rows], KIND)


def rows_of_every_kind(n=300, size=12):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, size)).astype(np.float32)
    x[50:90] = x[50]
    x[90:140] = x[90] + 0.02 * rng.standard_normal((50, size))
    x[140] = 3 * x[50]
    rows = [(int(i), [float(c) for c in v], int(i % 7 == 0)) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * size, 0), (1002, [NAN] + [1.0] * (size - 1), 0), (1003, [INF] * size, 0), (1004, [None] + [1.0] * (size - 1), 1)]
    rows += [(1005, [1.0, 2.0], 0), (1020, [2.0, 4.0], 0), (1040, [1.0, 2.0078125], 0), (1041, [1.0, -2.0], 0), (1042, [-3.0], 0), (1043, [-1.0], 0), (1006, [], 0), (1007, rows[50][1], None), (1008, rows[90][1], None), (None, rows[0][1], 0), rows[3], rows[51]]
    return rows


def sound(rows):
    return [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]


def test_neighbours_of_every_kind_of_row(spark):
    rows = rows_of_every_kind()
    ok = sound(rows)
    got = {}
    for r in kmeans_tree.search(frame(spark, rows), F.col("id") % 20 == 0, k=5, recall=1.0, leaves=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for i, q, _ in ok:
        if i % 20:
            continue
        best = sorted((-float((v * q).sum()), j) for j, v, _ in ok if j != i and len(v) == len(q))[:5]
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5][: len(best)]
        exact = {j: float((v * q).sum()) for j, v, _ in ok if len(v) == len(q)}
        assert all(s == pytest.approx(exact[j], rel=1e-12) and j != i for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j in best} & {f[1] for f in found})
        total += len({j for _, j in best})
    assert hits >= 0.97 * total


def test_fewer_rows_than_asked(spark):
    few = [(20, [1.0, 0.0], 1), (40, [0.0, 1.0], 1), (41, [1.0, 1.0], 1)]
    got = kmeans_tree.search(frame(spark, few), F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 41, 1.0), (20, 2, 40, 0.0), (40, 1, 41, 1.0), (40, 2, 20, 0.0)]
    for rows in ([], few[:1], few[2:], [(20, None, 1)]):
        assert kmeans_tree.search(frame(spark, rows), F.col("id") % 20 == 0).count() == 0


def test_every_query_gets_its_rows_beside_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(32)
    x = np.vstack([np.tile(hot, (3940, 1)), 4 * rng.standard_normal((60, 32))])[rng.permutation(4000)]
    short = rng.standard_normal((30, 3))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000 + 20 * i, v.tolist(), 0) for i, v in enumerate(short)]
    rows += [(0, x[0].tolist(), 0)] * 30
    got = Counter(r.query_id for r in kmeans_tree.search(frame(spark, rows), F.col("id") % 20 == 0, k=20).select("query_id").collect())
    assert set(got) == {i for i, _, _ in rows if i % 20 == 0} and set(got.values()) == {20}


def test_query_reaches_its_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(d.embedding.tolist(), float), d.vec_id.to_numpy()
    got = QUERIES["op2_kmeans_tree_neighbours"](spark, "/root/testdata/sf0.1").toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -(x @ x[i]))) if j != i][:20]
        hits.append(len(set(ids[order]) & got[ids[i]]) / 20)
    assert np.mean(hits) >= 0.95 and min(hits) >= 0.3


def test_tree_places_and_visits_all_leaves():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 6))
    tree = kmeans_tree.grow(x, float(np.linalg.norm(x, axis=1).max()), 30)
    assert set(tree.place(x)) == set(range(tree.leaves)) == set(tree.visits(x[0], tree.leaves).tolist()) and tree.leaves <= 30
    same = kmeans_tree.grow(np.ones((50, 6)), 3.0, 30)
    assert same.leaves == 1 and (same.place(np.ones((3, 6))) == 0).all()


def brute_classes(rows, threshold=0.98):
    """Multiset of (id, n_links, component, kept), all pairs compared."""
    ok = [v is not None and None not in v and np.isfinite(v).all() and any(v) and l is not None for _, v, l in rows]
    u = [np.array(v, float) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= threshold:
                n[a] += 1
                n[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = Counter()
    for a, (i, _, _) in enumerate(rows):
        low = min((rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None), default=None)
        out[(i, n[a], low, i is not None and i == low)] += 1
    return out


@pytest.mark.parametrize("tile", [9, 4096])
def test_classes_of_every_kind_of_row(spark, tile):
    rows = rows_of_every_kind()
    got = rotation_codes.near_duplicates(frame(spark, rows), tile=tile).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_classes(rows)


def test_classes_of_nothing(spark):
    assert rotation_codes.near_duplicates(frame(spark, [])).count() == 0
    odd = [(1, None, 1), (2, [], None), (None, None, None)]
    got = rotation_codes.near_duplicates(frame(spark, odd)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)])


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    a = rotation_codes.units(rng.standard_normal((400, 32)))
    b = rotation_codes.units(a + 0.15 * rng.standard_normal((400, 32)) / np.sqrt(32))
    true = (a * b).sum(1)
    errors = []
    for seed in range(20):
        turned, code, factor = rotation_codes.encode(np.vstack([a, b]), rotation_codes.rotations(32, 1, seed))
        errors.append((code[:400] / np.sqrt(32) * turned[400:]).sum(1) / factor[:400, 0] - true)
    assert abs(np.mean(errors)) < 0.002
    coded = rotation_codes.encode(np.vstack([a, b]), rotation_codes.rotations(32, 4))
    p, q = rotation_codes.candidates(slice(0, 400), slice(400, 800), coded, 0.98)
    assert {int(i) for i in np.flatnonzero(true >= 0.98)} <= {int(i) for i, j in zip(p, q) if i == j}
    assert len(p) < 2 * 400
