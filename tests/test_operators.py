import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattice_spectra.operators import bound, compare, distance, inference, knn, laplacian, localize, plotdata, predictor, profile, resample, slices, spectrum
from lattice_spectra.sources import nodes as sources
from lattice_spectra.sources import sinks


@pytest.fixture(scope="module")
def city(spark):
    return sources.spiral_town(spark, "city", 80, 3).persist()


@pytest.fixture(scope="module")
def made(city):
    return profile.profiles(city, 6)


def test_haversine_between_capitals(spark):
    two = sources.from_arrays(spark, "x", lat=[48.8566, 51.5074], lng=[2.3522, -0.1278])
    assert 330e3 < knn.pairs_geographic(two).first()["d"] < 360e3


def test_grid_equals_pairwise(spark):
    box = sources.uniform_box(spark, "box", 400, 1).unionByName(sources.uniform_box(spark, "other", 3, 2))
    key = lambda df: sorted((r["network"], r["src"], r["dst"], r["rk"]) for r in df.collect())
    assert key(knn.knn_geographic(box, 7, method="grid")) == key(knn.knn_geographic(box, 7, method="pairwise"))


def test_grid_across_the_180th_meridian_and_near_poles(spark):
    rng = np.random.default_rng(5)
    n = 400
    wrapped = [(179.9 + x + 180) % 360 - 180 for x in rng.uniform(0, 0.4, n)]
    rows = [("meridian", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-17, -16, n), wrapped, strict=True))]
    rows += [("pole", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(88, 90, n), rng.uniform(-180, 180, n), strict=True))]
    box = spark.createDataFrame(rows, "network string, node_id long, lat double, lng double")
    key = lambda df: sorted((r["network"], r["src"], r["rk"], r["dst"], round(r["d"], 3)) for r in df.collect())
    assert key(knn.knn_geographic(box, 7, method="grid")) == key(knn.knn_geographic(box, 7, method="pairwise"))


def test_blocks_equal_pairwise(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 40)
    rng = np.random.default_rng(8)
    n = 150
    clusters = rng.normal(0, [[1e-5], [0.1], [3.0]], (3, 50)).ravel()
    rows = [("clusters", i, float(45 + a), float(5 + b)) for i, (a, b) in enumerate(zip(clusters, rng.permutation(clusters), strict=True))]
    rows += [("line", i, 10.0, float(x)) for i, x in enumerate(rng.uniform(-180, 180, n))]
    rows += [("pole", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(88, 90, n), rng.uniform(-180, 180, n), strict=True))]
    monkeypatch.setattr(knn, "CROWD", 2)
    rows += [("places", i, float(i % 3), 1.0) for i in range(120)] + [("two", 0, 1.0, 1.0), ("two", 1, 1.0, 2.0), ("one", 0, 1.0, 1.0)]
    box = spark.createDataFrame(rows, "network string, node_id long, lat double, lng double")
    key = lambda df: sorted((r["network"], r["src"], r["rk"], r["dst"], r["d"]) for r in df.collect())
    want = key(knn.knn_geographic(box, 7, method="pairwise"))
    assert key(knn.knn_geographic(box, 7, method="blocks")) == want and key(knn.knn_geographic(box, 7, method="grid")) == want
    assert knn.knn_geographic(box.where("false"), 7).count() == 0
    with pytest.raises(ValueError):
        knn.knn_geographic(box, 7, method="other")


def test_neighbours_between_two_sets_by_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("even", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(48.8, 48.9, 300), rng.uniform(2.3, 2.4, 300), strict=True))]
    rows += [("meridian", i, float(a), float((179.9 + b + 180) % 360 - 180)) for i, (a, b) in enumerate(zip(rng.uniform(-17, -16, 200), rng.uniform(0, 0.4, 200), strict=True))]
    rows += [("few", i, 1.0, float(i)) for i in range(6)] + [("untrained", 0, 1.0, 1.0)]
    box = spark.createDataFrame(rows, "network string, node_id long, lat double, lng double")
    train, test = box.where("node_id % 3 > 0"), box.where("node_id % 3 = 0 or node_id = 1")
    key = lambda df: sorted((r["network"], r["src"], r["rk"], r["dst"], r["d"]) for r in df.collect())
    want = key(knn.knn_between(test, train, 5))
    pairs = []
    monkeypatch.setattr(knn, "BETWEEN", 10)
    monkeypatch.setattr(knn, "_sides", lambda *a: pairs.append(a))
    assert key(knn._grid(train.where("network <> 'few'"), 5, ["network"], test.where("network not in ('few', 'untrained')"))) == [r for r in want if r[0] not in ("few", "untrained")] and not pairs
    monkeypatch.undo()
    monkeypatch.setattr(knn, "BETWEEN", 10)
    assert key(knn.knn_between(test, train, 5)) == want and len([r for r in want if r[0] == "few"]) == 3 * 4


def test_weights_are_symmetric_and_sigma_is_kept(city):
    w, sigma = knn.adjacency(knn.knn_geographic(city, 5), 250.0)
    table = {(r["src"], r["dst"]): r["w"] for r in w.collect()}
    assert all(table[b, a] == v for (a, b), v in table.items())
    assert sigma.first()["sigma"] == 250.0
    with pytest.raises(ValueError):
        knn.adjacency(knn.knn_geographic(city, 5), -1.0)


def test_coincident_points_raise(spark):
    same = sources.from_arrays(spark, "x", lat=[1.0] * 4, lng=[2.0] * 4)
    with pytest.raises(Exception, match="sigma must be positive"):
        knn.build_graph(same, k=2)[0].collect()


def test_graph_type_is_checked(city):
    with pytest.raises(ValueError):
        knn.build_graph(city, "other")
    with pytest.raises(ValueError):
        predictor.SpectralRegressor(graph_type="other")


def test_eigenpairs(made, city):
    rows = made.pairs.orderBy("mode").collect()
    values = np.array([r["lambda"] for r in rows])
    u = np.array([r["psi"] for r in rows]).T
    assert np.all(np.diff(values) >= 0) and values.min() > -1e-9 and values.max() < 2 + 1e-9
    assert np.allclose(u.T @ u, np.eye(80), atol=1e-9)
    assert abs(values.sum() - 80) < 1e-9
    lap = laplacian.symmetric_normalised(made.weights, city)
    few = spectrum.spectral_decomposition(lap, 5, "smallest").orderBy("mode").collect()
    assert np.allclose([r["lambda"] for r in few], values[:5])
    assert spectrum.spectral_decomposition(lap, 3, "both").count() == 6
    with pytest.raises(ValueError):
        spectrum.spectral_decomposition(lap, 3, "middle")


def test_distributed_singular_values(spark):
    box = sources.uniform_box(spark, "box", 60, 5)
    made = profile.profiles(box, 8)
    assert knn.connected(made.weights).select("part").distinct().count() == 1
    lap = laplacian.symmetric_normalised(made.weights, box)
    for which, order in (("smallest", "mode"), ("largest", F.desc("mode"))):
        far = spectrum.largest_first_singular(lap, 60, 4, which).select("lambda").distinct().toPandas()["lambda"]
        near = made.spectrum.orderBy(order).limit(4).toPandas()["lambda"]
        assert np.allclose(sorted(far), sorted(near), atol=1e-8)


def test_parts_are_the_zero_eigenvalues(made):
    zeros = made.spectrum.where("lambda < 1e-9").count()
    assert knn.connected(made.weights.where("w > 1e-9")).select("part").distinct().count() == zeros > 1


def test_local_spectra_equal_the_relational_ones(made, city):
    a = made.spectrum.orderBy("mode").toPandas()
    b = profile.spectra(city).orderBy("mode").toPandas()
    unique = a["lambda"] > 1e-6  # equal eigenvalues leave their vectors free
    assert np.allclose(a["lambda"], b["lambda"]) and np.allclose(a.ipr[unique], b.ipr[unique])


def rings(n, parts):
    """Entries of the normalised Laplacian of random weighted graphs near rings, in some parts."""
    rng = np.random.default_rng(n + parts)
    size = n // parts
    a = np.concatenate([np.arange(n)] * 3)
    b = np.concatenate([p * size + (np.arange(size) + s) % size for s in (1, 2, 5) for p in range(parts)])
    w = np.zeros((n, n))
    w[a, b] = rng.uniform(0.2, 1, len(a))
    return profile.local_laplacian((w + w.T) / 2)


@pytest.mark.parametrize(("n", "parts", "k"), [(400, 1, 12), (400, 4, 12), (400, 40, 12), (60, 1, 30)])
def test_sparse_modes_equal_dense_ones(n, parts, k):
    matrix = rings(n, parts)
    i, j = np.nonzero(matrix)
    values, vectors = np.linalg.eigh(matrix)
    for which, want in (("smallest", slice(0, k)), ("largest", slice(n - k, n))):
        got, psi = spectrum.sparse_eigen(i, j, matrix[i, j], n, k, which)
        assert np.abs(got - values[want]).max() < 1e-10
        assert np.abs(matrix @ psi - psi * got).max() < 1e-9 and np.abs(psi.T @ psi - np.eye(k)).max() < 1e-9
    with pytest.raises(ValueError):
        spectrum.sparse_eigen(i, j, matrix[i, j], n, n)


@pytest.mark.parametrize(("n", "parts"), [(400, 1), (400, 4), (401, 1)])
def test_slices_give_every_pair(n, parts, monkeypatch):
    monkeypatch.setattr(spectrum, "DENSE", 50)
    matrix = rings(n, parts)[: n - n % parts, : n - n % parts]
    i, j = np.nonzero(matrix)
    values = np.linalg.eigvalsh(matrix)
    found = list(spectrum.every_pair(i, j, matrix[i, j], len(matrix)))
    assert np.abs(np.sort(np.concatenate([v for v, *_ in found])) - values).max() < 1e-9
    whole = np.zeros((len(matrix), len(matrix)))
    at = 0
    for v, own, x in found:
        whole[own, at : at + len(v)] = x
        assert np.abs(matrix @ whole[:, at : at + len(v)] - whole[:, at : at + len(v)] * v).max() < 1e-8
        at += len(v)
    assert np.abs(whole.T @ whole - np.eye(len(matrix))).max() < 1e-7


def test_large_local_spectra_need_no_dense_matrix(city, monkeypatch):
    want = profile.spectra(city).orderBy("mode").toPandas()

    def no_dense(*_):
        raise AssertionError("a dense matrix")

    frame = city.toPandas().sort_values("node_id")
    a, o = np.radians(frame.lat.to_numpy()), np.radians(frame.lng.to_numpy())
    x = np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])
    near, dist = profile.local_edges(x, frame.node_id.to_numpy(), 6, lambda i, j: profile.between(a[i], o[i], a[j], o[j]))
    *entries, used = profile.sparse_laplacian(near, dist, None)
    monkeypatch.setattr(profile, "local_laplacian", no_dense)
    monkeypatch.setattr(spectrum, "DENSE", 20)
    values, ipr = spectrum.participations(*entries, len(frame))
    unique = want["lambda"] > 1e-6
    assert abs(used - want.sigma[0]) < 1e-6 and np.allclose(values, want["lambda"], atol=1e-9) and np.allclose(ipr[unique], want.ipr[unique])


def test_mode_statistics_by_either_way(city, made, monkeypatch):
    lap = laplacian.symmetric_normalised(made.weights, city)
    want = made.pairs.select("mode", "lambda", "psi").toPandas().sort_values("mode")
    ipr = np.array([(np.array(p) ** 4).sum() for p in want.psi])
    unique = (want["lambda"] > 1e-6).to_numpy()
    for limit in (10, 10_000):
        monkeypatch.setattr(spectrum, "DENSE", limit)
        got = spectrum.mode_statistics(lap, 4).toPandas().sort_values("mode").reset_index(drop=True)
        assert np.allclose(got["lambda"], want["lambda"], atol=1e-9) and np.allclose(got.ipr[unique], ipr[unique]) and (got.n == 80).all()
        kept = got[got.psi.notna()]
        assert sorted(kept["mode"]) == sorted(got.sort_values(["ipr", "mode"], ascending=[False, True])["mode"][:4])
        assert all(abs((np.array(r.psi) ** 4).sum() - r.ipr) < 1e-9 and len(r.node_ids) == 80 for r in kept.itertuples())


def test_moments_and_coefficients_are_those_of_the_eigenpairs(city, made, monkeypatch):
    lap = laplacian.symmetric_normalised(made.weights, city)
    pairs = made.pairs.toPandas().sort_values("mode")
    values = pairs["lambda"].to_numpy()
    got = spectrum.moments(lap, 3).first()
    assert np.allclose([got["m1"], got["m2"], got["m3"]], [(values**p).sum() for p in (1, 2, 3)])
    assert np.allclose(list(spectrum.moments(lap).first())[1:], [values.sum(), (values**2).sum()])
    y = city.select("network", "node_id", "y")
    own = y.toPandas().set_index("node_id").y
    want = float((own.to_numpy() ** 2).sum())
    for limit in (10, 10_000):
        monkeypatch.setattr(spectrum, "DENSE", limit)
        c = spectrum.coefficients(lap, y).toPandas().sort_values("mode").reset_index(drop=True)
        assert np.allclose(c["lambda"], values, atol=1e-9) and abs((c.c**2).sum() / want - 1) < 1e-9
        sums = [abs(float(np.array(p) @ own.loc[list(i)].to_numpy())) for p, i in zip(pairs.psi, pairs.node_ids, strict=True)]
        assert np.allclose(c.c.abs()[values > 1e-6], np.array(sums)[values > 1e-6], atol=1e-7)
    assert abs(bound.r2_of_coefficients(spectrum.coefficients(lap, y), y).first()["r2"] - 1) < 1e-9


def test_energies_are_sums_over_all_modes(city, made, spark):
    lap = laplacian.symmetric_normalised(made.weights, city)
    y = city.where("node_id <> 7").select("network", "node_id", F.when(F.col("node_id") != 9, F.col("y")).alias("y"))
    y = y.unionByName(spark.createDataFrame([("city", 3, 2.5), ("city", 999, 4.0), ("none", 1, 1.0)], y.schema))  # twice, without a node, without a network
    c = spectrum.coefficients(lap, y).toPandas()
    got = spectrum.energies(lap, y).collect()
    assert len(got) == 1 and got[0]["network"] == "city" and np.allclose([got[0]["e0"], got[0]["e1"]], [(c.c**2).sum(), (c["lambda"] * c.c**2).sum()])
    r2 = lambda df: {r["network"]: round(r["r2"], 9) for r in df.collect()}
    assert r2(bound.r2_of_energies(spectrum.energies(lap, y), y)) == r2(bound.r2_of_coefficients(spectrum.coefficients(lap, y), y))


@pytest.mark.parametrize("name", ["dirichlet_by_modes", "r2_full_basis"])
def test_queries_of_sums_over_all_modes_need_no_eigenpairs(spark, name):
    from lattice_spectra.plans import catalogue

    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_header_is_the_summary_without_its_statistics(made):
    head, whole = made.header().first(), made.summary().first()
    assert all(head[c] == whole[c] for c in ("network", "n", "sigma", "k_nn", "graph_type", "has_features", "has_target")) and abs(head["lambda_min"] - whole["lambda_min"]) < 1e-9


def test_queries_of_some_modes_ask_for_those_only(spark, monkeypatch):
    from lattice_spectra.plans import catalogue

    asked = []
    real = spectrum.spectral_decomposition
    monkeypatch.setattr(spectrum, "spectral_decomposition", lambda lap, k=None, *a, **how: asked.append(k) or real(lap, k, *a, **how))
    for name in ("select_k_modes", "ceiling_curve", "select_k_fixed", "eigs_moments", "eigs_cube_moment", "dirichlet_by_modes", "r2_full_basis"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [64, 64, 16]


def test_partial_pairs_by_either_way(city, made, monkeypatch):
    lap = laplacian.symmetric_normalised(made.weights, city)
    full = {r["mode"]: r["lambda"] for r in made.pairs.collect()}
    for limit in (10, 10_000):
        monkeypatch.setattr(spectrum, "DENSE", limit)
        for which in spectrum.WHICH:
            found = spectrum.spectral_decomposition(lap, 5, which).collect()
            assert len(found) == (10 if which == "both" else 5) and all(abs(r["lambda"] - full[r["mode"]]) < 1e-9 for r in found)
    assert spectrum.spectral_decomposition(lap, 500, clip=True).count() == 80
    with pytest.raises(Exception, match="k must be"):
        spectrum.spectral_decomposition(lap, 500).collect()


def test_participation_of_known_vectors(spark):
    rows = [("x", 0, i, 1.0) for i in range(10)] + [("x", 1, i, float(i == 3)) for i in range(10)] + [("x", 2, i, 0.0) for i in range(10)]
    got = {r["mode"]: r["ipr"] for r in spectrum.ipr_long(spark.createDataFrame(rows, "network string, mode int, node_id int, psi double")).collect()}
    assert abs(got[0] - 0.1) < 1e-12 and got[1] == 1 and got[2] == 0


def test_level_spacing_of_random_spectra(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 300))
    values = np.linalg.eigvalsh((a + a.T) / 2)
    loose = np.cumsum(rng.exponential(size=2000))
    df = spark.createDataFrame(pd.DataFrame({"network": ["g"] * 300 + ["p"] * 2000, "lambda": np.concatenate([values, loose])}))
    got = {r["network"]: r["r"] for r in spectrum.level_spacing(df).groupBy("network").agg(F.avg("r").alias("r")).collect()}
    assert 0.48 < got["g"] < 0.58 and 0.35 < got["p"] < 0.42


def test_dirichlet_forms_agree(made, city):
    y = city.select("network", "node_id", "y")
    a = laplacian.dirichlet_energy(made.weights, y).first()["energy"]
    b = laplacian.rayleigh(laplacian.unnormalised(made.weights), y).first()["energy"]
    assert abs(a - b) < 1e-9


def test_r2_of_known_subspaces():
    rng = np.random.default_rng(0)
    y = rng.normal(size=30)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    assert bound.r2_subspace(np.zeros((30, 0)), y) == 0 and bound.r2_subspace(np.zeros((30, 2)), y) == 0
    assert abs(bound.r2_subspace(q, y) - 1) < 1e-12 and abs(bound.r2_subspace(y[:, None], y) - 1) < 1e-12
    curve = bound.prefix_curve(None, q, y)
    assert np.all(np.diff(curve) >= -1e-12)
    for k in (1, 4, 16):
        assert abs(curve[k] - bound.r2_subspace(q[:, :k], y)) < 1e-12
    with pytest.raises(ValueError):
        bound.r2_subspace(q[:5], y)
    x = np.column_stack([y + 1, y + 1])
    assert bound.r2_subspace(x, y, rank_safe=True) <= bound.r2_subspace(x, y) + 1e-12


def test_bound_grows_with_modes_and_features(city, made):
    features = ["x1", "x2", "x3", "x4"]
    a, b = made.ceiling(4, features).first(), made.ceiling(16, features).first()
    assert a["r2_augmented"] <= b["r2_augmented"] + 1e-12 and b["r2_augmented"] >= b["r2_imd"]
    bare = made.ceiling(8).first()
    assert bare["r2_imd"] == 0 and bare["r2_augmented"] == bare["r2_spectral_only"]
    far = bound.r2_distributed(city, features)
    near = bound.r2_subspace(city.select(*features).toPandas().to_numpy(), city.select("y").toPandas().y.to_numpy())
    assert abs(far - near) < 1e-9


def test_augmented_columns(city, made):
    wide = bound.augment_features(city, spectrum.modes_long(made.pairs), 3).toPandas()
    assert {"mode_0", "mode_1", "mode_2"} <= set(wide.columns) and len(wide) == 80
    assert np.allclose(wide[["mode_1", "mode_2"]].std(ddof=0), 1)


def test_choice_of_k(made):
    grid = bound.k_grid(20)
    assert grid == [1, 2, 4, 8, 16, 20]
    assert bound.choose_k([1, 2, 4], [0.5, 0.6, 0.605], "elbow") == 2
    assert bound.choose_k([1, 2, 4], [0.5, 0.96, 1.0], "ratio") == 2
    assert made.select_k("fixed", fixed_k=7).first()["k"] == 7
    assert made.select_k("elbow").first()["k"] in bound.k_grid(64)
    with pytest.raises(ValueError):
        made.select_k("other")


def test_localisation_of_known_modes(spark):
    rows = [("x", 0, i, float(i == 3)) for i in range(20)] + [("x", 1, i, 1.0) for i in range(20)] + [("x", 2, i, 0.0) for i in range(20)]
    found = localize.bottleneck_nodes(spark.createDataFrame(rows, "network string, mode int, node_id int, psi double")).groupBy("mode").agg(F.count("*").alias("n"), F.min("node_id").alias("i")).collect()
    got = {r["mode"]: (r["n"], r["i"]) for r in found}
    assert got[0] == (1, 3) and got[1][0] >= 18 and 2 not in got


def test_zones_are_ranked(made):
    zones = localize.zones_nested(made.bottleneck_zones(4)).orderBy("zone_rank").collect()
    assert [z["zone_rank"] for z in zones] == [1, 2, 3, 4]
    assert all(a["ipr"] >= b["ipr"] for a, b in zip(zones, zones[1:], strict=False))
    masses = [n["mass"] for n in zones[0]["nodes"]]
    assert masses == sorted(masses, reverse=True)


def test_summary(made):
    row = made.summary(["x1"]).first()
    assert row["n"] == 80 and row["has_target"] and row["r2_augmented_k16"] >= row["r2_imd"]
    assert "80 nodes" in made.described().first()["text"]


@pytest.fixture(scope="module")
def cities(spark):
    whole = None
    for i, name in enumerate("abcd"):
        one = sources.spiral_town(spark, name, 50 + 5 * i, i, width=0.003 + 0.002 * i).drop("y")
        whole = one if whole is None else whole.unionByName(one)
    return whole.persist()


def test_comparison_is_symmetric_with_unit_diagonal(cities):
    spec = profile.spectra(cities, k_nn=5).persist()
    matrix = {(r["a"], r["b"]): r["s"] for r in compare.similarity_matrix(spec).collect()}
    assert len(matrix) == 16 and all(matrix[x, x] == 1 for x in "abcd") and all(abs(matrix[a, b] - matrix[b, a]) < 1e-12 for a, b in matrix)
    wide = compare.wide_matrix(compare.similarity_matrix(spec).withColumnRenamed("a", "x").withColumnRenamed("x", "a"), "abcd")
    assert wide.count() == 4 and len(wide.columns) == 5
    with pytest.raises(ValueError):
        compare.similarity_matrix(spec.where("network = 'a'"))
    bands = compare.multiscale(spec)
    assert {r["band"] for r in bands.collect()} == {"low", "mid", "high"}
    with pytest.raises(ValueError):
        compare.multiscale(spec, [(0, 0.5), (0.5, 1)], ["one"])


def test_distances_with_ties(spark):
    rows = [("a", 0.0), ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("b", 1.0)]
    got = distance.distances(spark.createDataFrame(rows, "network string, v double")).first()
    assert abs(got["wasserstein"] - 1 / 3) < 1e-12 and abs(got["ks"] - 1 / 3) < 1e-12


def test_bootstrap_intervals(cities):
    raw = resample.bootstrap_similarities(cities, 4, k_nn=5).persist()
    table = resample.intervals(raw).toPandas()
    assert len(table) == 6 and (table.lower <= table["median"]).all() and (table["median"] <= table.upper).all()
    assert table["median"].is_monotonic_decreasing


def test_subsample_sizes_and_stability(cities):
    a = resample.subsample(cities, 0.7)
    b = resample.subsample(cities.repartition(7), 0.7)
    assert sorted(map(tuple, a.select("network", "node_id").collect())) == sorted(map(tuple, b.select("network", "node_id").collect()))
    assert {r["network"]: r["count"] for r in a.groupBy("network").count().collect()} == {"a": 35, "b": 38, "c": 42, "d": 46}
    assert resample.parity_draws([50, 20], 0.7, 2, 1)[0][1].tolist() == list(range(20))


def blocks(spark, n=8):
    rng = np.random.default_rng(1)
    rows = [(i, j, (0.9 if (i < n // 2) == (j < n // 2) else 0.5) + rng.normal(0, 0.01)) for i in range(n) for j in range(i + 1, n)]
    return spark.createDataFrame(rows, "a int, b int, s double")


def test_permutation_of_strong_blocks(spark):
    sim = blocks(spark)
    row = inference.permutation_test(sim, range(4), range(4, 8), 400).first()
    assert row["observed"] > 0.3 and row["p_value"] < 0.05
    same = inference.permutation_test(sim, range(4), range(4, 8), 50, parity=True).first()
    assert abs(same["observed"] - row["observed"]) < 1e-12
    with pytest.raises(ValueError):
        inference.permutation_test(sim, [0], [1, 2, 3])
    whole = inference.permutation_test(sim, range(4), range(4, 8), exact=True).first()
    assert whole["n_perm"] == 70 and abs(whole["p_value"] - 2 / 70) < 1e-12 and abs(whole["observed"] - row["observed"]) < 1e-12
    alone = spark.createDataFrame([(0, "A"), (1, "B")], "name int, grp string")
    assert np.isnan(inference.block_contrast(sim, alone).first()["contrast"])


def test_rank_correlation(spark):
    sim = blocks(spark)
    assert abs(inference.mantel_spearman(sim, sim).first()["rho"] - 1) < 1e-12
    assert abs(inference.spearman_p(0.5, 20) - 0.024769) < 1e-4


def test_folds(spark, city):
    sizes = sorted(r["count"] for r in predictor.kfold(city, 7).groupBy("fold").count().collect())
    assert sizes == [11, 11, 11, 11, 12, 12, 12]
    own = predictor.kfold_parity(10, 3, 0)
    assert np.bincount(own).tolist() == [4, 3, 3]


@pytest.mark.parametrize("protocol", predictor.PROTOCOLS)
def test_modes_help(city, protocol):
    scores, predictions = predictor.cross_validate(city, ["x1", "x2", "x3", "x4"], 8, protocol=protocol)
    row = predictor.cv_summary(scores).first()
    assert row["n_folds"] == 5 and row["gain_mean"] > 0
    assert predictions.count() == 80 and predictions.where("yhat_aug is null").count() == 0


def test_estimator_functions_equal_the_closed_form(city):
    from pyspark.ml.regression import LinearRegression

    own = predictor.kfold(city, 3)
    key = lambda found: [(r["fold"], round(r["baseline"], 9), round(r["augmented"], 9)) for r in found[0].orderBy("fold").collect()]
    plain = key(predictor.cross_validate(own, ["x1", "x2"], 4))
    assert key(predictor.cross_validate(own, ["x1", "x2"], 4, estimator=predictor.ridge_solver(1.0))) == plain
    model = LinearRegression(featuresCol="features", labelCol="y", predictionCol="yhat", regParam=0.001, solver="normal")
    assert predictor.cross_validate(own, ["x1"], 2, estimator=model)[0].count() == 3


def test_bad_protocol(city):
    with pytest.raises(ValueError):
        predictor.cross_validate(city, ["x1"], protocol="other")


def test_ridge_equals_the_closed_form(city):
    frame = city.toPandas()
    x, y = frame[["x1", "x2"]].to_numpy(), frame.y.to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(predictor.ridge_fit(city, ["x1", "x2"], 2.0).first()["coefficients"], w)


def test_regressor(city):
    from pyspark.ml.regression import LinearRegression

    own = predictor.SpectralRegressor(LinearRegression(featuresCol="features", labelCol="y", predictionCol="yhat", regParam=0.001), 8)
    with pytest.raises(RuntimeError):
        own.predict()
    marked = city.withColumn("train", F.col("node_id") % 4 != 0).withColumn("test", F.col("node_id") % 4 == 0)
    own.fit(marked, ["x1", "x2", "x3", "x4"], "train")
    scored = own.predict("test").join(city.select("node_id", "y"), "node_id").toPandas()
    assert len(scored) == 20 and np.corrcoef(scored.y, scored.yhat)[0, 1] > 0.5
    assert 0 < own.ceiling().first()["r2_augmented"] <= 1
    assert own.copy().model is None


def test_feature_graph(spark):
    rng = np.random.default_rng(0)
    own = sources.from_arrays(spark, "f", coords=rng.normal(size=(40, 3)), features=rng.normal(size=(40, 2)), target=rng.normal(size=40))
    made = profile.profiles(own, 5, graph_type="feature")
    assert made.summary().first()["graph_type"] == "feature"
    scores, _ = predictor.cross_validate(own, ["x1"], 4, graph_type="feature", protocol="inductive", k_nn=5)
    assert scores.count() == 5


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.from_arrays(spark, "x")
    with pytest.raises(ValueError):
        sources.from_arrays(spark, "x", lat=[1, 2], lng=[1, 2], target=[1.0])
    with pytest.raises(FileNotFoundError):
        sources.scan(spark, str(tmp_path / "none"))
    assert sources.scan(spark, str(tmp_path / "none"), missing="skip") is None
    df = spark.createDataFrame([("7", 1.0), ("1234567", 2.0)], "id string, v double")
    assert [r[0] for r in df.select(sources.zero_filled("id")).collect()] == ["000007", "1234567"]
    assert sources.network_path("/d", "x", "nodes") == "/d/network=x/nodes.parquet"
    sinks.write_parquet(df.withColumn("network", F.lit("a")), str(tmp_path / "p"))
    assert sources.scan(spark, str(tmp_path / "p"), ["id", "missing"]).columns == ["id"]
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_document({"t": df}, str(tmp_path / "d.json"))
    assert sinks.report(df, "%s has %.1f", "id", "v").first()["line"] == "7 has 1.0"


def test_streamed_means(spark, tmp_path):
    from lattice_spectra.streaming.demand import station_means

    rows = spark.createDataFrame([(1, 0.0), (1, float(np.log1p(2.0))), (2, None)], "id int, v double")
    rows.write.parquet(str(tmp_path / "in"))
    query = station_means(spark, str(tmp_path / "in"), rows.schema, "id", "v").writeStream.outputMode("complete").format("memory").queryName("means").start()
    query.processAllAvailable()
    query.stop()
    assert [(r[0], round(r[1], 9)) for r in spark.table("means").collect()] == [("1", 1.0)]


def test_plot_tables(city, made):
    hist = plotdata.histogram(city.select("network", F.col("y").alias("v")), ["network"]).toPandas()
    assert len(hist) == 50 and abs((hist.density * hist.width).sum() - 1) < 1e-9
    panels = plotdata.overview_data(city, made.pairs, made.spectrum)
    assert panels["map"].count() == 80 and panels["spectrum"].count() == 80 and panels["ceiling"].count() >= 7
    assert plotdata.ceiling_data(city, made.pairs, ["x1"]).count() >= 7


def test_figures(city, made, tmp_path):
    from xml.etree import ElementTree

    panels = plotdata.overview_data(city, made.pairs, made.spectrum)
    hist = plotdata.histogram(city.select("network", F.col("y").alias("v")), ["network"])
    cells = city.sparkSession.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "a", 1.0), ("b", "b", 1.0)], "a string, b string, s double")
    drawn = [
        sinks.Panel(panels["map"], "points", "lng", "lat", "mass", "mode <1>"), sinks.Panel(panels["spectrum"], "points", "lambda", "ipr"), sinks.Panel(panels["ceiling"], "line", "k", "r2"),
        sinks.Panel(hist, "bars", "left", "density", "width"), sinks.Panel(cells, "cells", "a", "b", "s"), sinks.Panel(cells.where("false"), "points", "s", "s"),
    ]
    sinks.write_figure(drawn, str(tmp_path / "f.svg"))
    root = ElementTree.parse(tmp_path / "f.svg").getroot()
    count = lambda tag: len(root.findall(f"{{http://www.w3.org/2000/svg}}{tag}"))
    assert count("circle") == 160 and count("rect") == 54 and count("polyline") == 1
    for bad in (sinks.Panel(cells, "other", "a", "b"), sinks.Panel(cells, "cells", "a", "b")):
        with pytest.raises(ValueError):
            sinks.write_figure([bad], str(tmp_path / "g.svg"))
    with pytest.raises(ValueError, match="marks"):
        sinks.write_figure([sinks.Panel(city.sparkSession.range(sinks.MARKS + 1).select("id", F.col("id").alias("y")), "points", "id", "y")], str(tmp_path / "h.svg"))


def test_feature_neighbours_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[50:] = x[0]  # coincident points: ties go to the smaller id
    own = sources.from_arrays(spark, "f", coords=x).unionByName(sources.from_arrays(spark, "g", coords=x[:3]))
    got = {(r["network"], r["src"], r["rk"]): r["dst"] for r in knn.knn_feature(own, 5).collect()}
    for name, n in (("f", 60), ("g", 3)):
        for i in range(n):
            d = np.sqrt(((x[:n] - x[i]) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((np.arange(n), d)) if j != i][:5]
            assert [got.get((name, i, r + 1)) for r in range(5)] == [*best, *[None] * (5 - len(best))]


def test_neighbours_within_one_task_equal_pairwise(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 4)
    rng = np.random.default_rng(11)
    rows = [("pole", i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(88, 90, 90), rng.uniform(-180, 180, 90), strict=True))]
    rows += [("line", i, 10.0, float(x)) for i, x in enumerate(rng.uniform(-180, 180, 90))]
    rows += [("places", i, float(i % 3), 1.0) for i in range(90)] + [("two", 0, 1.0, 1.0), ("two", 1, 1.0, 2.0), ("one", 0, 1.0, 1.0)]
    box = spark.createDataFrame(rows, "network string, node_id long, lat double, lng double")
    key = lambda df: sorted((r["network"], r["src"], r["rk"], r["dst"], r["d"]) for r in df.collect())
    assert key(knn.knn_geographic(box, 7, method="within")) == key(knn.knn_geographic(box, 7, method="pairwise"))
    train, test = box.where("node_id % 3 > 0"), box.where("node_id % 3 = 0 or node_id = 1")
    want = key(knn.knn_between(test, train, 5))
    monkeypatch.setattr(knn, "BETWEEN", 0)
    monkeypatch.setattr(knn, "_grid", None)
    assert key(knn.knn_between(test, train, 5)) == want


def test_inductive_rows_have_a_short_plan(city):
    rows = predictor.cross_validate(city, ["x1", "x2"], 4, protocol="inductive")[1]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan


def test_control_spectra_are_made_once(cities):
    found = resample.control_similarities(cities, (("base", None, None, 6), ("C", None, None, 8)))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_slices_hold_inverses_only(monkeypatch):
    rows, cols, values = (np.array(x) for x in zip(*[(i, j, 2.0 if i == j else -1.0) for i in range(400) for j in (i - 1, i, i + 1) if 0 <= j < 400], strict=True))
    blocks = slices.Blocks(rows, cols, values, 400)
    size = np.diff(blocks.ends)
    assert blocks.weight() == 8 * ((size * size).sum() + (size[1:] * size[:-1]).sum())
    x = np.random.default_rng(1).standard_normal((400, 3))
    kept = blocks.inverse(0.31)(x)
    monkeypatch.setattr(slices, "KEPT", 0)
    assert np.allclose(kept, blocks.inverse(0.31)(x)) and np.allclose(np.concatenate([v for v, _ in slices.slices(blocks)]), 2 - 2 * np.cos(np.pi * np.arange(1, 401) / 401))


def test_slices_take_few_factorisations(monkeypatch):
    n = 1200
    rows, cols, values = (np.array(x) for x in zip(*[(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n], strict=True))
    made = []
    real = slices.Blocks.inverse
    monkeypatch.setattr(slices.Blocks, "inverse", lambda self, shift: made.append(shift) or real(self, shift))
    found = list(slices.slices(slices.Blocks(rows, cols, values, n)))
    x = np.concatenate([x for _, x in found], axis=1)
    assert len(made) <= 10 and np.allclose(np.concatenate([v for v, _ in found]), 2 - 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1))) and np.abs(x.T @ x - np.eye(n)).max() < 1e-7


def test_all_pairs_are_dealt_into_parts(spark):
    box = sources.uniform_box(spark, "box", 40, 1)
    pairs = knn.pairs_geographic(box)
    assert pairs.count() == 40 * 39 and "_part" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_all_pairs_come_by_parts_of_both_sides(spark):
    n = 640
    box = sources.uniform_box(spark, "a", n, 1).unionByName(sources.uniform_box(spark, "b", n, 2))
    pairs = knn.pairs_geographic(box).select("network", "src", "dst", F.spark_partition_id().alias("task")).toPandas()
    assert len(pairs) == 2 * n * (n - 1) and not pairs.duplicated(["network", "src", "dst"]).any() and (pairs.src != pairs.dst).all()
    others = pairs.groupby(["task", pairs.index // 400]).dst.nunique()  # 400 rows of a node that met all others would have 400
    assert others.median() < 120


@pytest.mark.parametrize("which", ["smallest", "largest"])
def test_dissection_gives_the_end_of_a_grid(which, monkeypatch):
    from lattice_spectra.operators import dissection

    made = []
    fronts = dissection.Fronts.lowest
    monkeypatch.setattr(dissection.Fronts, "lowest", lambda self, k: made.append(fronts(self, k)) or made[-1])
    monkeypatch.setattr(spectrum, "FACTORS", 64 << 20)  # slices of this grid would be over it
    a, b = 101, 97
    at = np.arange(a * b).reshape(a, b)
    i, j = np.concatenate([at[1:].ravel(), at[:, 1:].ravel()]), np.concatenate([at[:-1].ravel(), at[:, :-1].ravel()])
    degree = np.bincount(np.r_[i, j], minlength=a * b)
    rows, cols = np.r_[i, j, at.ravel()], np.r_[j, i, at.ravel()]
    values, psi = spectrum.sparse_eigen(rows, cols, np.r_[-np.ones(2 * len(i)), degree], a * b, 12, which)
    whole = np.sort((2 - 2 * np.cos(np.pi * np.arange(a) / a))[:, None] + 2 - 2 * np.cos(np.pi * np.arange(b) / b), axis=None)
    assert len(made) == 1 and made[0] is not None and np.allclose(values, whole[:12] if which == "smallest" else whole[-12:], atol=1e-9) and np.allclose(psi.T @ psi, np.eye(12), atol=1e-8)


def test_dissection_keeps_halves_apart_and_counts():
    from lattice_spectra.operators import dissection

    rng = np.random.default_rng(8)
    x = rng.random((600, 2))
    i, j = knn.nearest_places(x, np.arange(600), x, np.arange(600), 4, True)
    hub = np.arange(1, 300)
    i, j = np.r_[i, np.zeros(299, int)], np.r_[j, hub]  # and a star
    matrix = np.zeros((600, 600))
    matrix[i, j] = matrix[j, i] = -1
    matrix[np.diag_indices(600)] = -matrix.sum(axis=1)
    rows, cols = np.nonzero(matrix)
    fronts = dissection.Fronts(rows, cols, matrix[rows, cols], 600)
    values = np.linalg.eigvalsh(matrix)
    assert sorted(fronts.order) == list(range(600)) and [fronts.count(s) for s in (-0.1, 0.7, 5.3)] == [(values < s).sum() for s in (-0.1, 0.7, 5.3)]
    y = rng.standard_normal((600, 3))
    assert np.allclose((matrix + 0.5 * np.eye(600)) @ (out := np.empty_like(y), out.__setitem__(fronts.order, fronts.inverse(-0.5)(y[fronts.order])))[0], y) and fronts.inverse(0.5) is None
    assert np.allclose(fronts.lowest(9)[0], values[:9], atol=1e-9)
