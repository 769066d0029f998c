"""Models against closed forms and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import components, density, density_leaves, features, leaves, medoids, models, neighbors, pairwise, report, silhouette


def frame(spark, x, **extra):
    data = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
    data.insert(0, "id", range(len(x)))
    return spark.createDataFrame(data.assign(**extra)).repartition(5)


def names(x):
    return [f"x{i}" for i in range(x.shape[1])]


def distances(x):
    total = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(total)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.4, (60, 3)) for c in (0, 4, 8)])
    return np.vstack([x, [[20.0, -20.0, 3.0]], x[:2]]), np.array([0] * 60 + [1] * 60 + [2] * 60 + [1] + [0] * 2)


def test_regressions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(size=200)
    df = frame(spark, x, y=y)
    a = np.column_stack([np.ones(200), x])
    want, rest, *_ = np.linalg.lstsq(a, y, rcond=None)
    got = {r.term: (r.coefficient, r.r2) for r in models.multiple_regression(df, names(x), "y").collect()}
    r2 = 1 - rest[0] / ((y - y.mean()) ** 2).sum()
    assert [got[t][0] for t in ["intercept", *names(x)]] == pytest.approx(list(want)) and got["x0"][1] == pytest.approx(r2)
    slope, intercept = np.polyfit(x[:, 0], y, 1)
    assert tuple(models.simple_regression(df, "x0", "y").first()) == pytest.approx((slope, intercept, np.corrcoef(x[:, 0], y)[0, 1] ** 2))
    assert models.simple_regression(df.withColumn("x0", F.lit(1.0)), "x0", "y").first()["slope"] is None


def test_principal_components(spark):
    x = np.random.default_rng(2).normal(size=(150, 4)) @ np.diag([4, 3, 1, 0.5])
    x -= x.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    vt = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    got = models.principal_components(frame(spark, x), names(x), ["id"]).orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    assert np.allclose(got, x @ vt.T)


def test_discriminant_closed_form(spark, blobs):
    x, y = blobs
    rng = np.random.default_rng(0)
    x = x + rng.normal(0, 2, x.shape)
    means = np.array([x[y == c].mean(0) for c in range(3)])
    pooled = sum(((x[y == c] - means[c]).T @ (x[y == c] - means[c])) for c in range(3)) / (len(x) - 3)
    w = np.linalg.solve(pooled, means.T)
    scores = x @ w - 0.5 * np.einsum("cp,pc->c", means, w) + np.log(np.bincount(y) / len(y))
    got = models.discriminant_predict(frame(spark, x, y=y), names(x), "y").orderBy("id").toPandas()
    assert (got["prediction"].to_numpy() == scores.argmax(1)).all()
    assert models.accuracy(frame(spark, x, y=y).withColumn("p", F.col("y")), "y", "p").first()[0] == 1.0
    assert models.confusion(models.discriminant_predict(frame(spark, x, y=y), names(x), "y"), "y").agg(F.sum("n")).first()[0] == len(x)


def test_logistic_only_for_binary_targets(spark, blobs):
    x, y = blobs
    skipped = models.logistic_accuracy(frame(spark, x, y=y), names(x), "y").first()
    assert skipped["accuracy"] is None and skipped["note"] == "No aplica"
    two = frame(spark, x[:120], y=y[:120])
    assert models.logistic_accuracy(two, names(x), "y").first()["accuracy"] == 1.0


def test_kmeans_elbow_and_mixture(spark, blobs):
    x, y = blobs[0][:180], blobs[1][:180]
    vectors = features.assemble(frame(spark, x), names(x)).select("id", "features")
    curve = [r.inertia for r in models.elbow(vectors, "id", ks=range(2, 6)).orderBy("k").collect()]
    assert all(a >= b for a, b in zip(curve, curve[1:]))
    for labelled in (models.kmeans_labels(vectors, "id"), models.mixture_labels(vectors, "id")):
        got = labelled.orderBy("id").toPandas()["cluster"].to_numpy()
        assert [len(set(got[y == c])) for c in range(3)] == [1, 1, 1] and len(set(got)) == 3


def test_mixture_of_seven_features_equals_a_plain_fit(spark):
    rng = np.random.default_rng(12)
    spread = [rng.normal(size=(7, 7)) * 0.4 + np.eye(7) for _ in range(3)]
    x = np.vstack([rng.normal(size=(120, 7)) @ s + c for s, c in zip(spread, (0, 2.5, -3))])
    vectors = features.assemble(frame(spark, x), names(x)).select("id", "features")
    centers, cost = models.fit_kmeans(vectors, "id", [3])[3]
    gaps = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    label = gaps.argmin(axis=1)
    assert cost == pytest.approx(gaps.min(axis=1).sum())
    assert all(np.square(x[label == g].mean(axis=0) - centers[g]).sum() <= models.MOVE * x.var(axis=0).mean() for g in range(3))
    w, before = np.eye(3)[label], -np.inf
    while True:
        n = w.sum(axis=0)
        means = (w.T @ x) / n[:, None]
        covs = [((x - m) * w[:, [g]]).T @ (x - m) / n[g] + models.RIDGE * np.eye(7) for g, m in enumerate(means)]
        logs = np.stack([np.log(n[g] / len(x)) - 0.5 * np.linalg.slogdet(2 * np.pi * c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - means[g], np.linalg.inv(c), x - means[g]) for g, c in enumerate(covs)], axis=1)
        total = np.logaddexp.reduce(logs, axis=1)
        w = np.exp(logs - total[:, None])
        if abs(total.mean() - before) < models.GAIN:
            break
        before = total.mean()
    model = models.fit_mixture(vectors, "id", 3)
    assert model.means == pytest.approx(means, abs=1e-8) and model.covariances == pytest.approx(np.array(covs), abs=1e-8)
    got = models.mixture_labels(vectors, "id").orderBy("id").toPandas()["cluster"].to_numpy()
    assert (got == logs.argmax(axis=1)).all()
    assert models.mixture_labels(vectors.limit(0), "id").count() == 0 == models.kmeans_labels(vectors.limit(0), "id").count()


def brute_neighbours(x, y, k=5):
    d = distances(x)
    out = []
    for i in range(len(x)):
        near = np.argsort(d[i] ** 2, kind="stable")[:k]
        classes, votes = np.unique(y[near], return_counts=True)
        out.append(classes[votes.argmax()])
    return np.array(out)


@pytest.mark.parametrize("leaf_rows", [1000, 20])
def test_neighbours_exact_with_ties_and_hot_copies(spark, leaf_rows, monkeypatch):
    from tabscope.operators import leaves

    monkeypatch.setattr(leaves, "VISITORS_PER_TASK", 15)
    rng = np.random.default_rng(5)
    # a lattice makes many equal distances; a third of all rows are copies of one point
    x = np.vstack([rng.integers(0, 6, (200, 2)).astype(float), np.tile([[2.0, 3.0]], (100, 1)), rng.normal(30, 1, (12, 2))])
    y = rng.integers(0, 3, len(x))
    got = neighbors.knn_predict(frame(spark, x, y=y), names(x), "y", "id", leaf_rows=leaf_rows).orderBy("id").toPandas()
    assert (got["y"].to_numpy() == y).all()
    assert (got["prediction"].to_numpy() == brute_neighbours(x, y)).all()


def test_neighbours_with_fewer_rows_than_k(spark):
    x, y = np.array([[0.0], [1.0], [5.0]]), np.array([1, 0, 0])
    got = neighbors.knn_predict(frame(spark, x, y=y), ["x0"], "y", "id").collect()
    assert {r.prediction for r in got} == {0} and len(got) == 3


def brute_medoids(x, k):
    d = distances(x)
    chosen = list(np.argsort(d.sum(1), kind="stable")[:k])
    while True:
        label, new = d[:, chosen].argmin(1), []
        for g in range(k):
            mine = np.flatnonzero(label == g)
            cost = d[np.ix_(mine, mine)].sum(0)
            now = cost[list(mine).index(chosen[g])] if chosen[g] in mine else np.inf
            new.append(mine[cost.argmin()] if len(mine) and cost.min() < now else chosen[g])
        if new == chosen:
            return chosen, label
        chosen = new


@pytest.mark.parametrize("batch", [128, 4])
def test_medoids_are_exact_rows(spark, blobs, batch, monkeypatch):
    monkeypatch.setattr(medoids, "BATCH", batch)
    x = blobs[0] + np.random.default_rng(1).normal(0, 1.0, blobs[0].shape)
    want, label = brute_medoids(x, 3)
    got = medoids.medoid_labels(frame(spark, x), names(x), "id").orderBy("id").toPandas()
    assert (got["cluster"].to_numpy() == label).all()
    assert (got["medoid"].to_numpy() == np.array(want)[label]).all()


def brute_dbscan(x, eps, least):
    near = distances(x) <= eps
    core, label, at = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], at
        while stack:
            u = stack.pop()
            if core[u]:
                for v in np.flatnonzero(near[u] & (label == -1)):
                    label[v] = at
                    stack.append(v)
        at += 1
    return label


def test_density_exact(spark):
    rng = np.random.default_rng(9)
    plane = np.vstack([
        rng.normal(0, 0.08, (150, 2)),  # a third of the rows within one cell or two
        rng.uniform(-3, 3, (150, 2)), np.column_stack([np.linspace(1, 3, 60), np.full(60, 2.5)]),  # a thin chain
        np.tile([[2.0, -2.0]], (40, 1)), [[2.0, -1.72], [9.0, 9.0]],
    ])
    for eps, least in ((0.3, 5), (0.15, 4), (0.6, 12)):
        got = density.dbscan(frame(spark, plane), names(plane), "id", eps, least).orderBy("id").toPandas()["cluster"]
        assert (got.to_numpy() == brute_dbscan(plane, eps, least)).all(), (eps, least)


@pytest.mark.parametrize("leaf_points", [2500, 15])
def test_density_exact_in_five_dimensions(spark, leaf_points, monkeypatch):
    monkeypatch.setattr(density_leaves, "LEAF_POINTS", leaf_points)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.3, (120, 5)), rng.normal(1.2, 0.3, (90, 5)), np.tile([[3.0] * 5], (20, 1)), rng.uniform(-2, 4, (60, 5)),
                   rng.normal(3.15, 0.02, (20, 5))])
    got = density.dbscan(frame(spark, x), names(x), "id", 0.5, 5).orderBy("id").toPandas()["cluster"]
    assert (got.to_numpy() == brute_dbscan(x, 0.5, 5)).all()


def test_density_of_a_hot_spot_and_a_sheet_in_four_dimensions(spark, monkeypatch):
    monkeypatch.setattr(density_leaves, "LEAF_POINTS", 12)
    monkeypatch.setattr(density_leaves, "HELD", 3)
    monkeypatch.setattr(density_leaves, "HELD_LINKS", 20)
    rng = np.random.default_rng(8)
    # a third of the rows within eps of each other and never equal, some of them alone, borders between two clusters
    x = np.vstack([rng.normal(0, 0.01, (110, 4)), rng.uniform(-1, 1, (100, 4)) * [2, 2, 0.1, 0.1], np.tile([[0.4, 0, 0, 0]], (9, 1)), [[5.0] * 4], [[0.7, 0, 0, 0]],
                   rng.normal(1.0, 0.02, (30, 4)), [[1.25, 1.0, 1.0, 1.0]] * 2])
    for eps, least in ((0.3, 5), (0.3, 40), (0.1, 3), (3.0, 2)):
        got = density.dbscan(frame(spark, x), names(x), "id", eps, least).orderBy("id").toPandas()["cluster"]
        assert (got.to_numpy() == brute_dbscan(x, eps, least)).all(), (eps, least)
    assert density.dbscan(frame(spark, x).limit(0), names(x), "id", 0.3, 5).count() == 0


def test_two_dense_cells_whose_boxes_leave_it_open(spark):
    # boxes closer than eps although no two rows are: an L-shaped cell around an empty corner
    left = np.vstack([np.column_stack([np.full(9, 0.02), np.linspace(0.02, 0.68, 9)]), np.column_stack([np.linspace(0.02, 0.68, 9), np.full(9, 0.02)])])
    right = np.vstack([[[0.99, 0.99]] * 6, left + [[1.0, 1.0]] * len(left)])
    x = np.vstack([left, right])
    for eps in (1.0, 1.02, 1.05):
        got = density.dbscan(frame(spark, x), names(x), "id", eps, 5).orderBy("id").toPandas()["cluster"]
        assert (got.to_numpy() == brute_dbscan(x, eps, 5)).all(), eps


def test_components_of_a_chain_a_hub_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(400 + i, 400 + (i + 1) % 5) for i in range(5)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 300)} == {7} == {got[7]}
    assert {got[i] for i in range(401, 405)} == {400}
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").isEmpty()


def test_cuts_split_flags_and_repeated_values():
    from tabscope.operators.leaves import best_cut

    rng = np.random.default_rng(2)
    part = np.column_stack([(rng.random(4000) < 0.7) * 100.0, rng.integers(0, 3, 4000), rng.normal(size=4000)])
    sizes = [part]
    for _ in range(5):
        cut = []
        for rows in sizes:
            dim, at = best_cut(rows)
            left = rows[:, dim] <= at
            cut += [rows[left], rows[~left]]
        sizes = cut
    assert len(sizes) == 32 and min(map(len, sizes)) > 20 and max(map(len, sizes)) < 400
    assert best_cut(np.ones((9, 2))) == (0, np.inf)
    assert best_cut(np.array([[1.0, 5], [1, 5], [1, 5], [1, 6]])) == (1, 5.0)


def brute_silhouette(d, y):
    out = []
    for i in range(len(d)):
        mine = (y == y[i]).sum() - 1
        a = d[i][y == y[i]].sum() / mine if mine else None
        b = min(d[i][y == c].mean() for c in set(y) if c != y[i])
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes(spark, blobs):
    x, y = blobs
    y = np.where(np.arange(len(y)) == 180, 3, y)  # a cluster of one
    df, d = frame(spark, x, cluster=y), distances(x)
    assert silhouette.silhouette_squared(df, names(x)).first()["silhouette"] == pytest.approx(brute_silhouette(d**2, y))
    assert silhouette.silhouette_euclidean(df, names(x)).first()["silhouette"] == pytest.approx(brute_silhouette(d, y), abs=1e-9)
    single = df.withColumn("cluster", F.lit(0))
    for score in (silhouette.silhouette_squared, silhouette.silhouette_euclidean):
        assert tuple(score(single, names(x)).first())[1:] == (len(x), None)
        assert tuple(score(df.limit(0), names(x)).first())[1:] == (0, None)


@pytest.mark.parametrize("strip_rows,at_once", [(8192, 20_000), (7, 4)])
def test_silhouettes_of_many_clusters_with_copies(spark, monkeypatch, strip_rows, at_once):
    monkeypatch.setattr(silhouette, "STRIP_ROWS", strip_rows)
    monkeypatch.setattr(silhouette, "CLUSTERS_AT_ONCE", at_once)
    monkeypatch.setattr(silhouette, "HELD_SUMS", 3)
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 6, (14, 4))
    y = rng.integers(0, 14, 260)
    x = centres[y] + rng.normal(0, 0.5, (260, 4))
    x[:90], y[:90] = x[0], y[0]  # a third of the rows are copies
    x[90] = x[0]  # and one of them is in another cluster
    y[91:95] = 20, 21, 22, 23  # clusters of one
    df = frame(spark, x, cluster=[f"c{k}" for k in y])
    assert silhouette.silhouette_euclidean(df, names(x)).first()["silhouette"] == pytest.approx(brute_silhouette(distances(x), y), abs=1e-7)
    assert silhouette.silhouette_squared(df, names(x)).first()["silhouette"] == pytest.approx(brute_silhouette(distances(x) ** 2, y), abs=1e-9)


def test_model_comparison(spark, blobs, tmp_path):
    x, y = blobs
    df = frame(spark, x, y=y)
    table = report.compare_models(df, df, names(x), "id", "y", "x0", "x1", eps=1.0)
    rows = {r.model: r for r in table.collect()}
    assert len(rows) == 9 and rows["Regresión logística"].note == "No aplica" and rows["KNN"].score > 0.9
    best = report.best_model(table).first()
    assert best.score == max(r.score for r in rows.values() if r.metric == "silhouette")
    paths = report.write_report({"models": table}, str(tmp_path))
    assert spark.read.parquet(paths["models"]).count() == 9


def test_neighbours_through_two_levels_of_leaves(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = np.column_stack([rng.random(n) < 0.3, rng.normal(size=n)]).astype(float) * [50.0, 1.0]
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    parts = leaves.split(df.select("id", F.array("a", "b").alias("x")), "x", 2, 20, "test", level_depth=2)
    assert parts.levels >= 2 and parts.rows.count() == n
    assert parts.rows.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 40
    got = {r["id"]: r["prediction"] for r in neighbors.knn_predict(df, ["a", "b"], "y", "id", k=3, leaf_rows=20, level_depth=2).collect()}
    for i in range(n):
        d = ((x - x[i]) ** 2).sum(axis=1)
        near = pdf["y"].to_numpy()[np.lexsort((pdf["id"], d))[:3]]
        assert got[i] == np.bincount(near).argmax()


def test_leaves_of_equal_rows_stay_and_missing_features_are_refused(spark):
    same = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    parts = leaves.split(same, "x", 2, 10, "test")
    assert parts.levels == 0 and parts.rows.select("leaf").distinct().count() == 1
    assert leaves.split(same.limit(0), "x", 2, 10, "test").rows.count() == 0
    with pytest.raises(ValueError, match="missing"):
        leaves.matrix(pd.Series([[1.0, None]]), 2)


def test_copies_of_the_medoid_need_no_more_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 2))
    rounds = []
    plain = medoids._sums
    monkeypatch.setattr(medoids, "_sums", lambda *a: rounds.append(1) or plain(*a))

    def fit(points):
        rounds.clear()
        pdf = pd.DataFrame({"id": np.arange(len(points)), "a": points[:, 0], "b": points[:, 1]})
        found = medoids.fit_medoids(spark.createDataFrame(pdf), ["a", "b"], "id", k=1)
        return found[0][0], len(rounds)

    best, without = fit(x)
    copied, with_copies = fit(np.vstack([x, np.repeat(x[best:best + 1], 700, axis=0)]))
    assert copied == best and with_copies <= without


def test_first_medoids_count_copies_as_rows(spark):
    rows = [(4, 0.0), (1, 0.0), (2, 1.0), (3, -5.0), (5, 6.0)]
    df = spark.createDataFrame(rows, "id int, a double")
    out = {r["id"]: (r["cluster"], r["medoid"]) for r in medoids.medoid_labels(df, ["a"], "id", k=2).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and all(m in out for _, m in out.values())


@pytest.mark.parametrize("at_once", [20_000, 400])
def test_discriminant_of_many_classes_and_missing_features(spark, monkeypatch, at_once):
    monkeypatch.setattr(models, "CLASSES_AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    cls = np.repeat(np.arange(1500), 4)
    x = np.column_stack([cls % 40, cls // 40]) * 10.0 + rng.normal(scale=0.1, size=(6000, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "cls": [f"c{c}" for c in cls]})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(None, 1.0, "c1")], "a double, b double, cls string"))
    out = models.discriminant_predict(df, ["a", "b"], "cls").toPandas()
    assert (out["prediction"] == out["cls"])[:-1].all() and out["prediction"].iloc[-1] is None
    empty = models.discriminant_predict(df.limit(0), ["a", "b"], "cls")
    assert empty.count() == 0 and empty.columns == ["a", "b", "cls", "prediction"]


def test_rows_that_reach_all_boxes_are_handed_on_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(leaves, "SENT_CELLS", 1000)
    boxes = leaves.Boxes(np.arange(50), np.zeros((50, 10)), np.ones((50, 10)))
    asking = pd.DataFrame({"asker": range(40), "x": list(np.full((40, 10), 0.5)), "reach2": 1.0})
    parts = list(boxes.reached(asking, "x", "x"))
    assert max(map(len, parts)) <= 50
    assert sorted((a, b) for p in parts for a, b in zip(p["asker"], p["leaf"])) == [(a, b) for a in range(40) for b in range(50)]


def test_silhouette_sums_by_tiles(monkeypatch):
    monkeypatch.setattr(silhouette, "TILE_ROWS", (3, 5))
    rng = np.random.default_rng(8)
    a, b, wa, wb = rng.normal(size=(17, 4)), rng.normal(size=(23, 4)), rng.integers(1, 4, 17) * 1.0, rng.integers(1, 4, 23) * 1.0
    d = np.sqrt(np.square(a[:, None] - b[None]).sum(axis=2))
    left, right = silhouette._distance_sums(a, wa, b, wb, False)
    assert np.allclose(left, d @ wb) and np.allclose(right, wa @ d)
    own = np.sqrt(np.square(a[:, None] - a[None]).sum(axis=2))
    assert np.allclose(silhouette._distance_sums(a, wa, a, wa, True)[0], own @ wa, atol=1e-12)


def test_steps_of_a_fit_get_rows_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(models, "PACKED_ROWS", 7)
    x = np.random.default_rng(4).normal(size=(100, 3))
    vectors = features.assemble(frame(spark, x).repartition(3), names(x))
    packed = models._packed(vectors, 3)
    assert max(len(r["x"]) for r in packed.collect()) == 7 * 3 * 8
    assert np.allclose(models._summed(packed, 3, 4, lambda rows: np.append(rows.sum(axis=0), len(rows))), [*x.sum(axis=0), 100])
    near, gap = models._nearest(models._gaps(x, np.array([[0.0, 0, 0], [0, 0, 0], [1, 1, 1]])))
    assert set(near) == {0, 2} and (gap >= 0).all()


def test_density_sends_a_chunk_to_cells_and_not_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(density_leaves, "CELL_CHUNKS", 8)
    monkeypatch.setattr(density_leaves, "PAIRS_AT_ONCE", 7)
    chunks = spark.createDataFrame([(i, bytes([i])) for i in range(40)], "chunk bigint, x binary")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i, 40)], "chunk bigint, chunk_r bigint")

    def compare(batches):
        met = [(r.chunk, r.chunk_r, r.x[0] == r.chunk and r.x_r[0] == r.chunk_r, id(r.x)) for b in batches for r in b.itertuples(index=False)]
        yield pd.DataFrame({"u": [m[0] for m in met], "v": [m[1] for m in met], "right": [m[2] for m in met], "cell": len({m[3] for m in met})})

    got = density_leaves._beside(pairs, chunks, ["x"], compare, "u bigint, v bigint, right boolean, cell bigint").toPandas()
    assert sorted(zip(got["u"], got["v"])) == sorted((r[0], r[1]) for r in pairs.collect()) and got["right"].all()
    # 40 chunks, at most 6 cells each as either side, where 820 pairs would have sent 1,640
    assert got["cell"].max() <= 40


def test_density_compares_across_leaves_only_what_a_leaf_leaves_open(spark, monkeypatch):
    monkeypatch.setattr(density_leaves, "LEAF_POINTS", 40)
    monkeypatch.setattr(density_leaves, "CELL_CHUNKS", 2)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.uniform(0, 1, (300, 4)) * [4, 0.2, 0.2, 0.2], rng.normal(3, 0.02, (60, 4)), [[9.0] * 4, [-9.0] * 4]])
    plain, asked = density_leaves._counted, []
    monkeypatch.setattr(density_leaves, "_counted", lambda pairs, chunks, *a: asked.append(chunks.agg(F.sum("open")).first()[0]) or plain(pairs, chunks, *a))
    for eps, least in ((0.5, 5), (0.2, 12)):
        got = density.dbscan(frame(spark, x), names(x), "id", eps, least).orderBy("id").toPandas()["cluster"]
        assert (got.to_numpy() == brute_dbscan(x, eps, least)).all(), (eps, least)
    assert 2 <= asked[0] < 20


def test_groups_of_a_chunk_are_linked_once(spark):
    rng = np.random.default_rng(6)
    # three chunks of two groups each; a task that knows two groups to be connected does not say so again
    x = [np.vstack([rng.normal(0, 0.01, (9, 2)), rng.normal(5, 0.01, (9, 2)), [[2.5 + k, 2.5]]]) for k in range(3)]
    rows = [(k, (np.arange(19) + 100 * k).tobytes(), v.tobytes(), (np.arange(19) < 18).tobytes(), np.repeat([100 * k, 100 * k + 9, -1], [9, 9, 1]).tobytes()) for k, v in enumerate(x)]
    chunks = spark.createDataFrame([(k, f, v, c, g) for k, f, v, c, g in rows], "chunk bigint, first binary, x binary, core binary, group binary").coalesce(1)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "chunk bigint, chunk_r bigint")
    found = density_leaves._linked(pairs, chunks, 2, 1.0).collect()
    linked = {(r.u, r.v) for r in found}
    assert {r.kind for r in found} == {0} and {(min(p), max(p)) for p in linked} <= {(a + k, b + k) for k in (0, 9) for a, b in ((0, 100), (0, 200), (100, 200))}
    assert len(linked) >= 4


def test_silhouette_strips_are_not_sent_to_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(silhouette, "STRIP_ROWS", 10)
    monkeypatch.setattr(silhouette, "STRIPS_BYTES", 1000)
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(240, 3)), rng.integers(0, 3, 240)
    plain, sent = pairwise.new_path, []

    def path(spark, tag):
        sent.append(plain(spark, tag))
        return sent[-1]

    monkeypatch.setattr(pairwise, "new_path", path)
    got = silhouette.silhouette_euclidean(frame(spark, x, cluster=y), names(x)).first()["silhouette"]
    assert got == pytest.approx(brute_silhouette(distances(x), y), abs=1e-9)
    assert len(sent) == 1 and "silhouette-met" in sent[0]  # sums alone are written, block by block


def test_neighbours_meet_leaves_in_blocks_and_are_not_sent_to_them(spark, monkeypatch):
    from tabscope.operators import leaves

    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(leaves, "visits", None)  # no query beside a leaf is written
    rng = np.random.default_rng(7)
    # no structure, so all leaves are reached; far from zero, so that a product of short numbers is off
    x, y = rng.normal(size=(300, 12)) + 1000, [None if v == 3 else f"c{v}" for v in rng.integers(0, 4, 300)]
    x[40:46], x[50] = x[7], x[9]
    got = neighbors.knn_predict(frame(spark, x, y=y), names(x), "y", "id", leaf_rows=25).orderBy("id").toPandas()["prediction"].tolist()
    codes = np.array([-1 if v is None else int(v[1]) for v in y])
    assert [-1 if v is None else int(v[1]) for v in got] == brute_neighbours(x, codes).tolist()


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e20])
def test_closest_rows_are_exact_at_any_scale(scale):
    rng = np.random.default_rng(9)
    refs, q = (rng.integers(0, 9, (n, 3)) * scale + 5 * scale for n in (400, 50))
    d = sum((q[:, None, c] - refs[None, :, c]) ** 2 for c in range(3))
    bound = np.sort(d, axis=1)[:, 6]
    i, j, exact = neighbors._closest(q, refs, 5, bound)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(d <= bound[:, None]))) and (exact == d[i, j]).all()
    near = neighbors._Nearest(50, 5)
    i, j, exact = neighbors._closest(q, refs, 5)
    for some in (j % 2 == 0, j % 2 == 1):
        near.add(i[some], exact[some], j[some], j[some] % 3)
    assert (near.id == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
