import functools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import blocks, latent, models


def grid(m):
    out = []
    for r in range(m):
        for c in range(m):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < m and c + dc < m:
                    a, b = r * m + c, (r + dr) * m + c + dc
                    out += [(a, b), (b, a)]
    return out


def laplacian(edges, n):
    lap = np.zeros((n, n))
    for a, b in edges:
        lap[a, b] -= 1
        lap[a, a] += 1
    return lap


K1 = np.array([[1.0, 0.2], [0.2, 0.7]])


def a_system(spark, m, columns=2):
    e, n = grid(m), m * m
    rng = np.random.default_rng(1)
    w = rng.random((n, 2)) * (rng.random((n, 2)) > 0.3)
    b = rng.normal(size=(n, 2, columns))
    edges = spark.createDataFrame(e, "i long, j long")
    rows = [(i, np.diag(w[i]).ravel().tolist(), b[i].ravel().tolist()) for i in range(n)]
    a = np.einsum("ij,kl->ikjl", laplacian(e, n), K1)
    for i in range(n):
        a[i, :, i, :] += np.diag(w[i])
    return edges, spark.createDataFrame(rows, "area long, w array<double>, b array<double>"), a.reshape(2 * n, 2 * n), b.reshape(2 * n, columns)


@pytest.mark.parametrize("dense", [1500, 60])
def test_blocks_solve_as_the_dense_system(spark, dense):
    edges, systems, a, b = a_system(spark, 9)
    graph = blocks.dealt(edges, systems.select("area"), 2, dense)
    assert (graph.blocks == 1) == (dense == 1500)
    got = blocks.solve(systems, graph, K1, tol=1e-11)
    x = np.array([r["x"] for r in got.values.orderBy("area").collect()]).reshape(b.shape)
    assert np.abs(x - np.linalg.solve(a, b)).max() < 1e-8
    assert got.iterations <= (0 if dense == 1500 else 40)


def test_dealing_in_rounds_keeps_every_area(spark):
    edges = spark.createDataFrame(grid(7), "i long, j long")
    areas = spark.range(55).withColumnRenamed("id", "area")  # six of them have no neighbour
    got = blocks.deal(edges, areas, 12, links=0, rounds=6).collect()
    assert sorted(r["area"] for r in got) == list(range(55))
    assert 5 <= len({r["block"] for r in got}) <= 40


def test_grown_blocks_are_full():
    e = np.array(grid(20))
    block = blocks.grown(e[:, 0], e[:, 1], 400, 30)
    assert np.bincount(block).max() == 30 and len(np.bincount(block)) == 14


@pytest.mark.parametrize("dense", [1500, 40])
def test_variances_are_those_of_the_inverse(spark, dense):
    edges, systems, a, _ = a_system(spark, 5)
    graph = blocks.dealt(edges, systems.select("area"), 2, dense)
    assert (graph.blocks == 1) == (dense == 1500)
    got = blocks.marginal_variances(systems, edges, graph, K1, draws=300, tol=1e-6)
    v = np.array([r["x"] for r in got.orderBy("area").collect()]).ravel()
    want = np.diag(np.linalg.inv(a))
    assert np.allclose(v, want, rtol=1e-9) if dense == 1500 else np.abs(v / want - 1).max() < 0.25


def panel(spark, family, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(16):
        for y in range(2001, 2006):
            for _ in range(2):
                x, z = rng.normal(), rng.normal()
                eta = 0.5 * math.sin(a) + 0.3 * x + 0.2 * (y - 2003)
                rows.append((a, y, float(rng.poisson(math.exp(eta + 1))) if family == "poisson" else eta + rng.normal(), x, z, 1.0))
    return spark.createDataFrame(rows, "area long, year int, y double, x double, z double, off double"), rows


TAU = {"area": 1.5, "year": 2.0, "area_slope": 3.0, "year_slope": 1.0, "interaction": 4.0}
YEARS = list(range(2001, 2006))


def dense_fit(rows, spec, family):
    """The penalised fit of all terms by a plain dense iteration."""
    n, t = 16, len(YEARS)
    lap, r = laplacian(grid(4), n), models.rw1_matrix(t)
    y = np.array([v[2] for v in rows])
    off = np.ones(len(rows)) if family == "poisson" else np.zeros(len(rows))
    cols, pens, sums = [], [], []
    x = np.array([v[3] for v in rows])
    area = np.eye(n)[[v[0] for v in rows]]
    year = np.eye(t)[[v[1] - 2001 for v in rows]]
    cols.append(area), pens.append(TAU["area"] * lap), sums.append(np.zeros(n))
    if spec.area_slope:
        cols.append(area * x[:, None]), pens.append(TAU["area_slope"] * lap), sums.append(np.zeros(n))
    if spec.interaction:
        cells = (area[:, :, None] * year[:, None, :]).reshape(len(rows), -1) * x[:, None]
        k = {"I": np.eye(n * t), "II": np.kron(np.eye(n), r), "III": np.kron(lap, np.eye(t)), "IV": np.kron(lap, r)}[spec.interaction]
        cols.append(cells), pens.append(TAU["interaction"] * k), sums.append(np.zeros(n * t))
    cols.append(np.array([[v[4]] for v in rows])), pens.append(np.zeros((1, 1))), sums.append(np.zeros(1))
    cols.append(year), pens.append(TAU["year"] * r), sums.append(np.ones(t))
    if spec.year_slope:
        cols.append(year * x[:, None]), pens.append(TAU["year_slope"] * r), sums.append(np.ones(t))
    d, width = np.hstack(cols), sum(c.shape[1] for c in cols)
    p = np.zeros((width, width))
    at, null = 0, []
    for k, s in zip(pens, sums):
        p[at : at + len(k), at : at + len(k)] = k
        if s.any():
            row = np.zeros(width)
            row[at : at + len(k)] = s
            null.append(row)
        at += len(k)
    c = np.array(null)
    eta = off + math.log(y.sum() / np.exp(off).sum()) if family == "poisson" else off
    for _ in range(25 if family == "poisson" else 1):
        w, z = (np.exp(eta), eta - off + y / np.exp(eta) - 1) if family == "poisson" else (np.ones(len(y)), y)
        kkt = np.block([[d.T @ (w[:, None] * d) + p, c.T], [c, np.zeros((len(c), len(c)))]])
        eta = off + d @ np.linalg.lstsq(kkt, np.concatenate([d.T @ (w * z), np.zeros(len(c))]), rcond=1e-12)[0][:width]
    return eta


@pytest.mark.parametrize("family, kind", [("gaussian", "II"), ("gaussian", "IV"), ("poisson", "I")])
def test_joint_fit_is_that_of_the_dense_system(spark, family, kind):
    df, rows = panel(spark, family)
    edges = spark.createDataFrame(grid(4), "i long, j long")
    spec = models.ModelSpec("m", area_slope=kind != "I", year_slope=kind != "I", interaction=kind)
    model = latent.PanelModel(df, edges, "y", ["z"], "x", TAU, YEARS, family, "off" if family == "poisson" else None)
    fit = model.fit(spec)
    got = {(r["area"], r["year"], r["x"]): r["eta"] for r in fit.rows.collect()}
    want = dense_fit(rows, spec, family)
    assert max(abs(got[v[0], v[1], v[3]] - e) for v, e in zip(rows, want)) < 1e-5


def test_draws_have_the_complexity_of_the_hat_matrix(spark):
    df, rows = panel(spark, "gaussian")
    edges = spark.createDataFrame(grid(4), "i long, j long")
    spec = models.ModelSpec("m", year=False)
    model = latent.PanelModel(df, edges, "y", [], "x", TAU, YEARS)
    got = latent.criteria(model.fit(spec, draws=400)).first()
    area = np.eye(16)[[v[0] for v in rows]]
    closed = np.trace(np.linalg.solve(area.T @ area + TAU["area"] * laplacian(grid(4), 16), area.T @ area))
    assert got["n"] == len(rows) and abs(got["p_d"] - closed) < 0.06 * closed + 0.3
    assert got["dic"] == pytest.approx(got["d_bar"] + got["p_d"]) and math.isfinite(got["waic"])


def test_what_cannot_be_fitted_raises(spark):
    df, _ = panel(spark, "poisson")
    edges = spark.createDataFrame(grid(4), "i long, j long")
    model = latent.PanelModel(df, edges, "y", ["z"], "x", TAU, YEARS, "poisson", "off", max_steps=1)
    with pytest.raises(RuntimeError, match="not converged"):
        model.fit(models.MODEL_FAMILY[0])
    late = latent.PanelModel(df, edges, "y", ["z"], "x", TAU, YEARS[1:])
    with pytest.raises(Exception, match="not listed"):
        late.fit(models.MODEL_FAMILY[0])


def test_area_without_rows_borrows_from_its_neighbours(spark):
    df, _ = panel(spark, "gaussian")
    edges = spark.createDataFrame(grid(4), "i long, j long")
    model = latent.PanelModel(df.where("area != 5"), edges, "y", [], "x", TAU, YEARS)
    got = {r["area"]: r["effect"] for r in model.fit(models.MODEL_FAMILY[0]).area_effects().collect()}
    assert got[5] == pytest.approx(np.mean([got[a] for a in (1, 4, 6, 9)]))


def test_exceedance(spark):
    e = spark.createDataFrame([(1, 0.0), (2, 1.959963984540054)], "area long, mean double")
    v = spark.createDataFrame([(1, 4.0), (2, 1.0)], "area long, variance double")
    got = {r["area"]: r for r in latent.exceedance(e, v).collect()}
    assert got[1]["p_below"] == pytest.approx(0.5, abs=1e-6) and got[2]["p_below"] == pytest.approx(0.025, abs=1e-5)
    assert got[2]["q_low"] == pytest.approx(0, abs=1e-9)


def test_supplementary_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    x[:, 1] += x[:, 0]
    rows = [(*map(float, r), ["a", "b", None][i % 3]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "p double, q double, r double, s double, g string")
    pc = models.principal_components(df, ["p", "q", "r"])
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    score = z @ pc.vectors
    got = {(r["variable"], r["level"], r["component"]): r["value"] for r in models.supplementary(df, pc, ["s"], ["g"]).collect()}
    assert len(got) == 12
    for k in range(3):
        assert got["s", None, k + 1] == pytest.approx(np.corrcoef(x[:, 3], score[:, k])[0, 1])
        assert got["g", "b", k + 1] == pytest.approx(score[1::3, k].mean())
        assert got["g", None, k + 1] == pytest.approx(score[2::3, k].mean())
    assert models.supplementary(df, pc, categorical=["g"], k=1).agg(F.sum("n")).first()[0] == 200


def test_many_blocks_are_eliminated_exactly(spark, monkeypatch):
    # gradients took a job a step; levels of groups take two each, whatever the matrix
    edges, systems, a, b = a_system(spark, 12)
    graph = blocks.dealt(edges, systems.select("area"), 2, 20)
    assert graph.blocks > blocks.GROUP and len(next(iter(graph.paths.values()))) >= 2
    made = []
    store = blocks.reliable_checkpoint
    monkeypatch.setattr(blocks, "reliable_checkpoint", lambda d: made.append(1) or store(d))
    got = blocks.solve(systems, graph, K1, tol=1e-11)
    x = np.array([r["x"] for r in got.values.orderBy("area").collect()]).reshape(b.shape)
    assert np.abs(x - np.linalg.solve(a, b)).max() < 1e-9
    assert got.iterations == 0 and len(made) <= 8


def test_wide_graphs_are_solved_by_gradients(spark):
    edges, systems, a, b = a_system(spark, 9)
    graph = blocks.dealt(edges, systems.select("area"), 2, 60, front=10)
    assert graph.paths is None
    got = blocks.solve(systems, graph, K1, tol=1e-11)
    x = np.array([r["x"] for r in got.values.orderBy("area").collect()]).reshape(b.shape)
    assert got.iterations > 0 and np.abs(x - np.linalg.solve(a, b)).max() < 1e-8


@pytest.mark.parametrize("front", [blocks.FRONT, 0])
def test_joint_fit_in_many_blocks_is_that_of_one(spark, front):
    edges = spark.createDataFrame(grid(6), "i long, j long")
    rng = np.random.default_rng(3)
    rows = [(a, y, float(rng.normal()), float(rng.normal()), float(rng.normal())) for a in range(36) for y in (2001, 2002, 2003) if (a + y) % 5]
    d = spark.createDataFrame(rows, "area long, year int, y double, x double, z double")
    tau = dict.fromkeys(("area", "year", "area_slope", "year_slope", "interaction"), 0.5)
    spec = models.ModelSpec("all", True, True, "IV")
    out = []
    for dense in (1500, 45):
        model = latent.PanelModel(d, edges, "y", ["z"], "x", tau, [2001, 2002, 2003], dense=dense)
        if dense == 45:
            q = sum(n for _, n in model.unknowns(spec))
            model._graphs[q] = blocks.dealt(edges, d.select("area").distinct(), q, dense, front)
            assert model._graphs[q].blocks > 3 and (model._graphs[q].paths is None) == (front == 0)
        fit = model.fit(spec, draws=3)
        # effects and interaction share directions that only the predictor tells
        out.append(np.array([r["eta"] for r in fit.rows.orderBy("area", "year").collect()]))
    assert len(out[0]) == len(rows) and np.abs(out[0] - out[1]).max() < 1e-6


def test_draws_are_not_stored(spark):
    def size():
        return sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in fs)

    n, draws = 200, 400
    edges = spark.createDataFrame([(a, a + s) for a in range(n) for s in (-1, 1) if 0 <= a + s < n], "i long, j long")
    d = spark.createDataFrame([(a, y, float(a % 7), 1.0) for a in range(n) for y in (2001, 2002)], "area long, year int, y double, one double")
    model = latent.PanelModel(d, edges, "y", [], "one", {"interaction": 0.25}, [2001, 2002], dense=50)
    before = size()
    got = latent.criteria(model.fit(models.ModelSpec("i", interaction="I", area=False, year=False), draws=draws)).first()
    assert got["n"] == 2 * n
    assert size() - before < n * 2 * draws * 8 / 4


def test_a_block_is_eliminated_in_layers(monkeypatch):
    n, q = 400, 2
    e = grid(20) + [(0, 21), (21, 0)]
    links = [{"at": a, "other": 0, "there": b, "level": 0, "up": 0} for a, b in e if b < n]
    links += [{"at": a, "other": 1, "there": a, "level": 1, "up": 1} for a in range(380, n)]
    rng = np.random.default_rng(3)
    w = rng.random((n, q, 1)) * np.eye(q) * (np.arange(n) % 7 > 0)[:, None, None]
    d = blocks.Block(w, rng.normal(size=(n, q, 3)), links, 0, K1, np.zeros((q, q)))
    sizes, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: sizes.append(len(a)) or solve(a, b))
    f = d.front()
    left, (y, z), _ = f.eliminated(1)
    kept = rng.normal(size=(len(f.kept) * q, 3))
    x = f.values(kept)
    assert max(sizes) < n * q / 4  # the whole block before
    i, r = f._places(f.gone), f._places(f.kept)
    b = f.b.reshape(len(f.a), -1)
    assert np.abs(y - solve(f.a[np.ix_(i, i)], b[i])).max() < 1e-10
    assert np.abs(f.a[np.ix_(i, i)] @ z - f.a[np.ix_(i, r)]).max() < 1e-10
    assert np.abs(f.a @ x.reshape(len(f.a), -1) - b)[i].max() < 1e-10


def test_layers_join_neighbours_only():
    # two pieces, one of them a ring, and areas that are not to be placed
    i = np.array([0, 1, 2, 3, 4, 5, 7, 8, 9])
    j = np.array([1, 2, 3, 4, 5, 0, 8, 9, 6])
    of = np.array([0, 1, 2, 3, 4, 5, 7, 8, 10])
    got = blocks.layers(i, j, of, 2)
    assert sorted(np.concatenate(got).tolist()) == of.tolist()
    at = {a: k for k, some in enumerate(got) for a in some.tolist()}
    assert all(abs(at[a] - at[b]) <= 1 for a, b in zip(i.tolist(), j.tolist()) if a in at and b in at)
    assert blocks.layers(i, j, np.array([], int), 2) == []


def test_noise_of_a_link_is_drawn_once(monkeypatch):
    calls, rng = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda s: calls.append(s) or rng(s))
    root, none, known = blocks.root(K1), np.zeros((2, 2)), {}
    got = [blocks.prior_noise(a, near, root, none, 4, 1, known) for a, near in ((1, [2, 2]), (2, [1, 1]))]
    assert len(calls) == 2  # four without what is known: the link is listed twice at each end
    assert np.array_equal(got[0], -got[1])
    assert np.array_equal(got[0], blocks.prior_noise(1, [2, 2], root, none, 4, 1))


def test_rows_take_the_draws_of_their_year_only(spark, monkeypatch):
    years = list(range(2000, 2006))
    rows = [(a, y, float((a * y) % 5), float(a % 3)) for a in range(9) for y in years]
    d = spark.createDataFrame(rows, "area long, year int, y double, x double")
    edges = spark.createDataFrame(grid(3), "i long, j long")
    stored, store = [], latent.reliable_checkpoint
    monkeypatch.setattr(latent, "reliable_checkpoint", lambda f: stored.append(f) or store(f))
    model = latent.PanelModel(d, edges, "y", [], "x", dict.fromkeys(("area", "area_slope", "interaction"), 0.5), years)
    specs = [models.ModelSpec("i", True, False, "I", year=False), models.ModelSpec("base", year=False)]
    fits = [model.fit(s, draws=5) for s in specs]
    assert len(stored) == 1  # moments of the rows, the same for both models
    plan = latent.pointwise(fits[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("slice(e") == 3  # effect, slope and one of six years
    assert latent.pointwise(fits[1]).count() == len(rows)


def test_dealing_in_rounds_keeps_borders_short(spark, monkeypatch):
    # a strip ten areas wide; small clusters that were put together by hash joined its far ends
    at = {(k % 10, k // 10): k for k in range(3000)}
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    e = [(k, at[x + dx, y + dy]) for (x, y), k in at.items() for dx, dy in steps if (x + dx, y + dy) in at]
    edges = spark.createDataFrame(e, "i long, j long")
    areas = spark.range(3000).withColumnRenamed("id", "area")
    monkeypatch.setattr(blocks, "deal", functools.partial(blocks.deal, links=8000))
    monkeypatch.setattr(blocks, "_widest", lambda links, real=blocks._widest: seen.append(real(links)) or seen[-1])
    seen = []
    graph = blocks.dealt(edges, areas, 1, 40)
    assert seen[0] < 200
    sizes = [r["count"] for r in graph.placed.groupBy("block").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 40 and len(sizes) < 100


def test_dealing_in_rounds_without_links_between_areas(spark):
    edges = spark.createDataFrame([(100, 101), (101, 100), (3, 3), (5, 100)], "i long, j long")
    areas = spark.range(40).withColumnRenamed("id", "area")
    got = blocks.deal(edges, areas, 8, links=0).collect()
    assert sorted(r["area"] for r in got) == list(range(40))
    assert 5 <= len({r["block"] for r in got}) <= 10
