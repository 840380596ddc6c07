import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.operators import scaling
from keysift.operators.membership import KeyModelEstimator
from keysift.operators.occ import gmm, gmm_vector, iforest, rbf, registry, rp, svm_primal
from keysift.plans import cross_validation
from keysift.plans.catalog.model_queries import differing

BY = ["table_id"]


def slow_intervals(values, params):
    """The gap rule on sorted values, one after another."""
    values = sorted(values)
    gap = (values[-1] - values[0]) * params.epsilon
    least = len(values) * params.box_thr
    islands, island = [], [values[0]]
    for v in values[1:]:
        if v < island[-1] + gap:
            island.append(v)
        else:
            islands.append(island)
            island = [v]
    islands.append(island)
    extra = 0.0 if params.closed else rp.WIDENING
    kept = [i for i in islands if (len(i) - 1 >= least if params.closed else len(i) - 1 > least)]
    return sorted({(i[0] - extra, i[-1] + extra) for i in kept})


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("epsilon,box", [(0.01, 0.0), (0.05, 0.02), (0.002, 0.001)])
def test_intervals_match_the_sequential_rule(spark, closed, epsilon, box):
    rng = random.Random(11)
    columns = {(t, d): [rng.choice([rng.gauss(0, 1), rng.gauss(6, 0.3), float(rng.randint(0, 9))]) for _ in range(120)] for t in range(3) for d in range(2)}
    columns[(3, 0)] = [2.5] * 20  # no spread at all
    rows = spark.createDataFrame([(t, d, v) for (t, d), vs in columns.items() for v in vs], "table_id int, dim int, value double")
    params = rp.RPParams(2, epsilon, 0.9, box, closed=closed)
    got = {}
    for r in rp.fit_intervals(rows, BY, params).collect():
        got.setdefault((r["table_id"], r["dim"]), []).append((r["lo"], r["hi"]))
    for place, values in columns.items():
        assert sorted(got.get(place, [])) == slow_intervals(values, params)


def model_keys(spark):
    rng = random.Random(2)
    rows = [(t, f"h:{rng.randint(0, 60) + 100 * t}:{rng.randint(0, 60):x}") for t in range(3) for _ in range(150)]
    return spark.createDataFrame(rows, "table_id int, key string")


def test_batch_lookup_equals_joined_lookup_and_plain_python(spark):
    keys, params = model_keys(spark), rp.RPParams(5, 0.03, 0.5, 0.01)
    model = registry.fit_rp(keys, BY, {"D": 5, "epsilon": 0.03, "agg_thr": 0.5, "box_thr": 0.01})
    assert model.fits_broadcast()
    probes = keys.select("key").distinct().withColumn("table_id", F.explode(F.array(*map(F.lit, range(3)))))
    joined = rp.RPModel(BY, params, model.planes, model.intervals, model.features, limit=-1)
    answers = lambda m: {(r["table_id"], r["key"]): r["accepted"] for r in m.accept(m.prepare(probes)).collect()}
    first = answers(model)
    assert first == answers(joined)
    spans = {}
    for r in model.intervals.collect():
        spans.setdefault((r["table_id"], r["dim"]), []).append((r["lo"], r["hi"]))
    for (t, key), accepted in first.items():
        _, a, b = key.split(":")
        v = model.planes @ np.array([float(a), float(int(b, 16))])
        hits = sum(any(lo < v[d] < hi for lo, hi in spans.get((t, d), [])) for d in range(5))
        assert accepted == (hits > 2.5)


def test_joins_of_few_directions_give_the_same_answers(spark, monkeypatch):
    """Lookups are joined a few directions at a time, so that the JVM compiles their code; also rows without a table or a number."""
    keys = model_keys(spark)
    odd = spark.createDataFrame([(0, "h:x:1"), (0, None), (7, "h:1:1"), (None, "h:1:1")], keys.schema)
    model = registry.fit_rp(keys, BY, {"D": 5, "epsilon": 0.03, "agg_thr": 0.5, "box_thr": 0.01})
    rows = lambda: sorted(map(tuple, model.accept(model.prepare(keys.union(odd))).select("table_id", "key", "accepted").collect()), key=str)
    few = rows()
    assert len(model.packed()) == 3 and len(few) == keys.count() + 4
    monkeypatch.setattr(rp, "JOINED_DIMS", 5)
    assert rows() == few


def test_long_rows_meet_small_cells_without_a_shuffle(spark):
    keys = model_keys(spark)
    model = registry.fit_rp(keys, BY, {"D": 5, "epsilon": 0.03, "agg_thr": 0.5, "box_thr": 0.01})
    long = model.prepare(keys.distinct()).select("table_id", "key", F.posexplode("_v").alias("dim", "value"))
    plan = rp.score_long(long, model.intervals, BY, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_differing_rows_are_those_of_both_differences(spark):
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "n int, s string")
    second = spark.createDataFrame([(1, "a"), (3, None), (None, "c"), (4, "d"), (4, "d")], "n int, s string")
    want = first.exceptAll(second).unionByName(second.exceptAll(first))
    assert sorted(map(tuple, differing(first, second).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_directions_drawn_in_tasks_equal_the_local_ones(spark):
    planes = rp.unit_planes(3, 7)
    for r in rp.plane_rows(spark, 3, 7).collect():
        assert r["w"] == pytest.approx(planes[r["dim"], r["feature"]], abs=1e-12)


def test_reject_share_is_near_nu(spark):
    rows = spark.range(2000).select((F.col("id") % 2).cast("int").alias("table_id"), F.array(F.randn(1), F.randn(2)).alias("x"))
    from keysift.session import materialize

    rows = materialize(rows)
    for nu in (0.05, 0.3):
        answered = rbf.fit(rows, BY, rbf.RBFParams(nu=nu), 2).score(rows)
        shares = [r["support_ratio"] for r in rbf.support_ratio(answered, BY).collect()]
        assert all(abs(s - nu) < 0.01 for s in shares)


def test_mixture_likelihood_rises_and_finds_the_clusters(spark):
    rng = np.random.RandomState(0)
    rows = [(0, float(x), float(y)) for c in (0.0, 5.0) for x, y in rng.normal(c, 0.3, size=(40, 2))]
    df = spark.createDataFrame(rows, "table_id int, x0 double, x1 double")
    components, trace = gmm.fit(df, BY, max_iter=6)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    means = [r["m0"] for r in components.where("weight > 0.05").collect()]
    assert all(min(abs(m), abs(m - 5)) < 1.5 for m in means)


def plain_em(x, k, rounds, cuts):
    """The same expectation maximisation for one table, row by row."""
    place = np.array([int((cuts < v).sum()) * k // 100 for v in x[:, 0]])
    r = np.stack([place == i for i in range(k)], axis=1).astype(float)
    trace = []
    for turn in range(rounds + 1):
        if turn:
            logs = np.empty((len(x), len(w)))
            for j in range(len(w)):
                diff = x - m[j]
                _, det = np.linalg.slogdet(c[j])
                logs[:, j] = np.log(w[j]) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + det + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c[j]), diff))
            ll = np.log(np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)) + logs.max(axis=1)
            r = np.exp(logs - ll[:, None])
            trace.append(ll.mean())
        r = r[:, r.sum(axis=0) > 1e-9]
        w, m = r.sum(axis=0) / len(x), (r.T @ x) / r.sum(axis=0)[:, None]
        c = [np.einsum("i,ij,ik->jk", r[:, j], x - m[j], x - m[j]) / r[:, j].sum() + 1e-6 * np.eye(x.shape[1]) for j in range(len(w))]
    return w, m, c, trace


def test_plane_mixtures_equal_em_of_each_table(spark, monkeypatch):
    monkeypatch.setattr(gmm, "BLOCK_ROWS", 40)
    monkeypatch.setattr(gmm, "PACK_ROWS", 90)
    rng = np.random.RandomState(5)
    points = {t: np.concatenate([rng.normal(c, 0.2, size=(n, 2)) for c, n in ((0.0, n // 2), (3.0, n // 4), (9.0, n // 4))]) for t, n in ((0, 48), (1, 200))}
    rows = [(t, *map(float, x)) for t, xs in points.items() for x in xs]
    df = spark.createDataFrame(rows, "table_id int, x0 double, x1 double").repartition(3)
    components, trace = gmm.fit(df, BY, max_iter=4, tolerance=0.0)
    totals = np.zeros(4)
    for t, x in points.items():
        cuts = df.where(f"table_id = {t}").agg(F.percentile_approx("x0", [i / 100 for i in range(1, 100)], 1000)).first()[0]
        k = 9 if len(x) >= 60 else max(1, len(x) // 10)
        w, m, c, own = plain_em(x, k, 4, np.array(cuts))
        totals += np.array(own) * len(x)
        got = components.where(f"table_id = {t}").orderBy("component").collect()
        assert np.allclose([r["weight"] for r in got], w)
        assert np.allclose([[r["m0"], r["m1"]] for r in got], m)
        assert np.allclose([[r["c00"], r["c01"], r["c11"]] for r in got], [[v[0, 0], v[0, 1], v[1, 1]] for v in c])
    assert np.allclose(trace, totals / sum(map(len, points.values())))
    odd = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (None, 1.5, 1.0)], df.schema)
    blocks = gmm.blocks_of(df.union(odd), BY).collect()
    assert sorted(v for b in blocks for v in b["x0s"]) == sorted([1.5, *(r[1] for r in rows)])
    assert max(len(b["x0s"]) for b in blocks) <= 40


def test_components_far_from_a_run_of_rows_add_nothing(monkeypatch):
    monkeypatch.setattr(gmm, "RUN_ROWS", 16)
    rng = np.random.RandomState(6)
    x = rng.uniform(size=(300, 2))
    order = gmm.neighbours(x[:, 0], x[:, 1])
    assert sorted(order.tolist()) == list(range(300))
    turned = rng.normal(size=(25, 2, 2)) * 0.02
    c = turned @ turned.transpose(0, 2, 1) + 1e-6 * np.eye(2)
    mix = {"weight": rng.dirichlet(np.ones(25)), "m0": rng.uniform(size=25), "m1": rng.uniform(size=25), "c00": c[:, 0, 0], "c01": c[:, 0, 1], "c11": c[:, 1, 1]}
    got = gmm.moments(x[order, 0], x[order, 1], mix)
    monkeypatch.setattr(gmm, "NEGLIGIBLE", -np.inf)
    assert np.allclose(got, gmm.moments(x[:, 0], x[:, 1], mix), rtol=1e-11, atol=1e-15)


def test_vector_mixtures_equal_em_of_each_table(spark, monkeypatch):
    monkeypatch.setattr(gmm_vector, "BLOCK_NUMBERS", 5 * 40)
    monkeypatch.setattr(gmm_vector, "CHUNK_ROWS", 30)
    rng, rows = np.random.RandomState(3), []
    tables = {7: np.concatenate([rng.normal(c, 0.5, (60, 5)) + 100 for c in (0, 3)]), 8: rng.normal(0, 1, (70, 5)) @ rng.normal(0, 1, (5, 5))}
    for t, x in tables.items():
        rows += [(t, v.tolist()) for v in x]
    odd = [(7, None), (7, [1.0, None, 2.0, 3.0, 4.0]), (8, [1.0]), (8, [float("nan")] * 5), (9, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd[:-1], "table_id int, x array<double>").repartition(3)
    components, trace = gmm_vector.fit(df, BY, 5, max_iter=4, tolerance=0.0)
    assert len(trace) == 4 and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    means = []
    for t, x in tables.items():
        q = df.where(f"table_id = {t} and size(x) = 5 and not exists(x, v -> v is null or isnan(v))").agg(
            F.percentile_approx(F.col("x")[0], [i / 100 for i in range(1, 100)], 1000)).first()[0]
        w, m, c, plain = plain_em(x, 9, 4, np.array(q))
        got = components.where(f"table_id = {t}").orderBy("component").collect()
        assert [r["weight"] for r in got] == pytest.approx(w.tolist(), abs=1e-6)
        assert np.allclose([r["mean"] for r in got], m, atol=1e-6)
        factors = [np.array(r["factor"]).reshape(5, 5) for r in got]
        assert all(np.allclose(f @ f.T, cov, atol=1e-6) for f, cov in zip(factors, c))
        means.append((plain, len(x)))
    assert trace == pytest.approx([sum(p[i] * n for p, n in means) / sum(n for _, n in means) for i in range(4)], abs=1e-6)
    scored = gmm_vector.with_log_likelihood(spark.createDataFrame(rows[:40] + odd, "table_id int, x array<double>"), components, BY, 5).collect()
    assert len(scored) == 45 and sum(r["ll"] is None for r in scored) == 5


def test_far_components_of_a_vector_mixture_are_told_by_few_dimensions():
    rng = np.random.RandomState(8)
    means = rng.normal(size=(12, 20)) * 30
    factors = np.linalg.cholesky(np.stack([a @ a.T + np.eye(20) for a in rng.normal(size=(12, 20, 20))]))
    mixture = gmm_vector.Mixture(rng.dirichlet(np.ones(12)), means, factors)
    x = np.concatenate([means.repeat(15, axis=0) + rng.normal(size=(180, 20)), rng.normal(size=(20, 20)) * 40])
    whole = np.stack([mixture._density(k, x, 20) for k in range(12)], axis=1)
    got = mixture.log_densities(x)
    assert np.isinf(got).sum() > 1000
    assert np.allclose(got[np.isfinite(got)], whole[np.isfinite(got)])
    assert np.allclose(gmm_vector.log_sum(got), gmm_vector.log_sum(whole), rtol=1e-13)
    assert (np.exp(whole - gmm_vector.log_sum(whole)[:, None])[np.isinf(got)] < 2e-22).all()


def test_vector_mixture_of_flat_and_few_rows(spark):
    """Rows in a line, and fewer rows than dimensions: the covariance is raised until it has a factor."""
    rows = [(0, [float(i), 2.0 * i, 1e9]) for i in range(12)] + [(1, [1.0, 2.0, 3.0])]
    components, _ = gmm_vector.fit(spark.createDataFrame(rows, "table_id int, x array<double>"), BY, 3, max_iter=3)
    assert {r["table_id"] for r in components.collect()} == {0, 1}
    nothing, trace = gmm_vector.fit(spark.createDataFrame([], "table_id int, x array<double>"), BY, 3)
    assert nothing.count() == 0 and trace == []


def test_component_rule(spark):
    sizes = [1, 9, 10, 59, 60, 10000, 10001]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(gmm.component_count(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == [1, 1, 1, 5, 9, 9, 100]


def test_forest_scores_outliers_higher_and_walks_right(spark):
    rng = np.random.RandomState(1)
    points = [list(map(float, p)) for p in rng.normal(0, 1, size=(300, 2))] + [[9.0, 9.0]]
    rows = spark.createDataFrame([(0, str(i), p) for i, p in enumerate(points)], "table_id int, id string, x array<double>")
    from keysift.session import materialize

    samples = materialize(iforest.tree_samples(rows, BY, "id", 15))
    assert {r["count"] for r in samples.groupBy("tree").count().collect()} == {256}
    nodes = materialize(iforest.grow_trees(samples, BY, "id"))
    scores = {tuple(r["x"]): r["score"] for r in iforest.score(rows, nodes, BY, 15, samples).collect()}
    assert max(scores, key=scores.get) == (9.0, 9.0)
    tree = {(r["tree"], r["node"]): r for r in nodes.collect()}
    for x in points[:20]:
        total = 0.0
        for t in range(15):
            at = 1
            while tree[(t, at)]["feature"] >= 0:
                at = 2 * at + (x[tree[(t, at)]["feature"]] > tree[(t, at)]["value"])
            total += tree[(t, at)]["path"]
        assert scores[tuple(x)] == pytest.approx(2 ** (-(total / 15) / float(iforest.average_path(256))))


def test_constant_columns_scale_by_one(spark):
    rows = spark.createDataFrame([(0, [1.0, float(i)]) for i in range(5)], "table_id int, x array<double>")
    for fit in (scaling.fit_standard, scaling.fit_minmax):
        assert fit(rows, BY).where("dim = 0").first()["scale"] == 1.0


@pytest.mark.parametrize("name", ["epsilon", "svmsimple", "svmprimal", "isolationforest", "np", "dic", "alwaysNegative"])
def test_every_family_answers_every_row(spark, name):
    keys = model_keys(spark)
    chosen = registry.family(name)
    params = {"trees": 5} if name == "isolationforest" else chosen.sample
    model = chosen.fit(keys, BY, params)
    answered = model.accept(model.prepare(keys)).agg(F.count("accepted").alias("n"), F.count_if("accepted").alias("yes")).first()
    assert answered["n"] == keys.count()
    if name in ("np", "dic"):
        assert answered["yes"] == answered["n"]


def test_grids_have_their_sizes():
    assert len(list(registry.rp_grid())) == 3000
    assert len(list(registry.rbf_grid())) == 48
    with pytest.raises(ValueError):
        registry.family("unknown")


def test_key_model_accepts_its_own_keys(spark):
    keys = model_keys(spark)
    model = KeyModelEstimator(D=4, epsilon=0.2, agg_thr=0.5, box_thr=0.0).fit(keys)
    answered = model.transform(keys.distinct())
    assert answered.count() == keys.distinct().count()
    assert answered.where("prediction = 1").count() > 0.9 * answered.count()
    unknown = spark.createDataFrame([(0, "zz")], "table_id int, key string")
    assert model.transform(unknown).count() == 1


@pytest.mark.parametrize("name", ["gaussianmixture", "kernelepsilon"])
def test_further_families_fit_back_up_and_answer(spark, name):
    """A family's own rejects fall to its backup filter, so no table denies its own key."""
    from keysift.operators.occ import registry
    from keysift.plans import evaluation

    rows = [(t, f"h:{(7 * i + 3 * t) % 50}:{(i * i) % 40:x}") for t in range(2) for i in range(80)]
    keys = spark.createDataFrame(rows, "table_id int, key string")
    chosen = registry.family(name)
    model = chosen.fit(keys, ["table_id"], {**chosen.sample, **({"max_iter": 5} if name == "gaussianmixture" else {})})
    filters, rejects = evaluation.backup_filters(keys, model, ["table_id"], 0.1)
    assert evaluation.denied_keys(keys, model, filters).isEmpty()
    assert sum(r["rejects"] for r in rejects.collect()) < len(rows)
    assert {r["table_id"] for r in chosen.size(model).collect()} == {0, 1}


def test_grid_search_equals_separate_fits(spark):
    """Every setting fitted and scored fold by fold in NumPy, with an equation solved for each."""
    rng = np.random.RandomState(5)
    rows = [(i, int(i % 3), (rng.normal(i % 3, 0.8, 4)).tolist()) for i in range(150)]
    odd = [(900, None, [1.0] * 4), (901, 1, None), (902, 1, [1.0]), (903, 1, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "id long, label int, x array<double>").repartition(3)
    kernels = [cross_validation.Kernel("linear"), cross_validation.Kernel("rbf", 0.2, 20)]
    got = {(r["kernel"], r["c"]): r for r in cross_validation.grid_search(df, "id", kernels, [0.1, 10.0], folds=4).collect()}
    assert len(got) == 4 and min(r["rank"] for r in got.values()) == 1
    whole = df.where("size(x) = 4 and label is not null and not exists(x, v -> v is null)")
    folded = cross_validation.stratified_folds(whole, 4, "id").collect()
    x, label, fold = np.array([r["x"] for r in folded]), np.array([r["label"] for r in folded]), np.array([r["fold"] for r in folded])
    assert all(abs((fold[label == k] == f).sum() - (label == k).sum() / 4) < 1 for k in range(3) for f in range(4))
    targets = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    for kernel in kernels:
        z = kernel.map(x)
        for c in (0.1, 10.0):
            shares = []
            for f in range(4):
                train, held = fold != f, fold == f
                w = np.linalg.solve(z[train].T @ z[train] + np.eye(z.shape[1]) / c, z[train].T @ targets[train])
                shares.append(((z[held] @ w).argmax(axis=1) == label[held]).mean())
            assert got[kernel.name, c]["mean_accuracy"] == pytest.approx(np.mean(shares))
            assert got[kernel.name, c]["sd_accuracy"] == pytest.approx(np.std(shares))
    assert got["rbf", 10.0]["mean_accuracy"] > 0.6
    assert cross_validation.grid_search(df.limit(0), "id", kernels, [1.0]).count() == 0


def solved_dual(z, nu, rounds=4000):
    """Least norm of a mean of rows with no weight above one over ``nu n``, by many small steps."""
    n = len(z)
    alpha = np.full(n, 1 / n)
    for t in range(rounds):
        worst = np.zeros(n)
        order = np.argsort(z @ (alpha @ z))
        worst[order[: int(nu * n)]] = 1 / (nu * n)
        alpha += 2 / (t + 2) * (worst - alpha)
    return 0.5 * float((alpha @ z) @ (alpha @ z))


def test_feature_sums_by_score_range(monkeypatch):
    monkeypatch.setattr(svm_primal, "STEP_ROWS", 70)
    rng, params = np.random.RandomState(3), svm_primal.SVMParams(features=16)
    x, w = rng.normal(size=(500, 2)), rng.normal(size=16)
    z = params.map(x)
    scores = z @ w
    place = np.clip(((scores + 0.4) / 1.0 * svm_primal.RANGES).astype(int), 0, svm_primal.RANGES - 1)
    totals = np.zeros((svm_primal.RANGES, 16))
    np.add.at(totals, place, z)
    counts, got, low, high = svm_primal.range_sums(x, w, -0.4, 0.6, params)
    assert np.array_equal(counts, np.bincount(place, minlength=svm_primal.RANGES))
    assert np.allclose(got, totals) and np.allclose([low, high], [scores.min(), scores.max()])
    assert svm_primal.range_sums(x, w, 0.0, 0.0, params)[0][0] == 500


def test_primal_machine_against_its_dual(spark):
    rng, rows = np.random.RandomState(4), []
    tables = {0: rng.normal(0, 1, (200, 2)), 1: np.concatenate([rng.normal(-2, 0.3, (150, 2)), rng.normal(2, 0.6, (150, 2))])}
    for t, x in tables.items():
        rows += [(t, v.tolist()) for v in x]
    df = spark.createDataFrame([*rows, (0, None), (1, [1.0, None]), (1, [1.0])], "table_id int, x array<double>").repartition(3)
    params = svm_primal.SVMParams(nu=0.2, gamma=0.5, tol=1e-3, features=32, max_iter=40)
    model = svm_primal.fit(df, BY, params, 2)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(model.trace, model.trace[1:]))
    found = {r["table_id"]: r for r in model.weights.collect()}
    for t, x in tables.items():
        best = solved_dual(params.map(x), 0.2)
        assert best * 0.99 <= found[t]["objective"] <= best * 1.03
        w = np.array(found[t]["w"])
        assert found[t]["objective"] == pytest.approx(0.5 * w @ w)
    answered = model.predict(df).collect()
    assert len(answered) == len(rows) + 3
    for t, x in tables.items():
        known = [r for r in answered if r["table_id"] == t and r["score"] is not None]
        assert len(known) == len(x)
        assert abs(sum(r["prediction"] == -1 for r in known) / len(x) - 0.2) < 0.03
    ratios = {r["table_id"]: r["support_ratio"] for r in svm_primal.support_ratio(model, df.where("size(x) = 2")).collect()}
    assert all(abs(v - 0.2) < 0.03 for v in ratios.values())
