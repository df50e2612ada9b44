"""Trees and logistic regressions for many experiments: definitions, both ways of growing, shared passes."""

import numpy as np
import pytest

from gridfare.operators import logistic, models, trees
from gridfare.operators.trees import Experiment, Learner


def table(spark, n=1_200, width=4, folds=(0, 1), classes=True):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width)).round(2)
    raw = x[:, 0] + (x[:, 1] > 0.3) * 2 + 0.3 * rng.normal(size=n)
    y = (raw > 0.8).astype(float) if classes else raw.round(3)
    data = [(f, i, i % 2 != f, float(y[i]), 1.0 + (i % 3) / 2, x[i].tolist()) for i in range(n) for f in folds]
    frame = spark.createDataFrame(data, "fold int, id long, train boolean, y double, weight double, x array<double>").repartition(5)
    return x, y, frame


def experiments(width, depth=5, regression=False):
    kinds = {"forest": 4, "extra_trees": 4, "boosting": 6}
    share = "all" if regression else "sqrt"
    return [
        Experiment(kind, "whole", fold, tuple(range(width)), Learner(kind, n, 3 if kind == "boosting" else depth, "all" if kind == "boosting" else share, regression=regression))
        for kind, n in kinds.items() for fold in (0, 1)
    ]


def predicted(rows, own, edges, **settings):
    found = trees.predict(rows, trees.fit(rows, own, edges, **settings), own, chunk_rows=200)
    return {(r["experiment"], r["id"]): r["p"] for r in found.collect()}


@pytest.mark.parametrize("classes", [True, False])
def test_levels_and_tasks_grow_the_same_trees(spark, monkeypatch, classes):
    """A node may split in a pass over all rows or in the task where its rows meet; passes may be many; the answer is one."""
    x, y, values = table(spark, classes=classes)
    edges = trees.column_edges(values, 4)
    rows = trees.binned(values, edges).persist()
    own = experiments(4, regression=not classes)
    whole = predicted(rows, own, edges)
    assert len(whole) == len(own) // 2 * len(y)
    monkeypatch.setattr(trees, "PASS_CELLS", 3 * 4 * trees.BINS)
    assert predicted(rows, own, edges, node_rows=90) == whole
    for number, spec in enumerate(own):
        ids = [i for e, i in whole if e == number]
        assert all(i % 2 == spec.fold for i in ids)
        guess = np.array([whole[number, i] for i in ids])
        if classes:
            assert ((guess > 0.5) == (y[ids] > 0)).mean() > 0.8
        elif spec.model != "boosting":
            assert np.corrcoef(guess, y[ids])[0, 1] > 0.8


def test_the_best_split_is_the_one_of_least_impurity():
    """One column and node against all cuts by the definition of the weighted Gini impurity."""
    rng = np.random.default_rng(1)
    bins, y, weight = rng.integers(0, 9, 300), rng.integers(0, 2, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    y[bins > 5] = 1
    learner = Learner("forest", 1, 1, "all")
    stats = trees.statistics(learner, np.ones(300, np.int64), y, weight)
    grown = trees.grow(learner, 0, bins[:, None].astype(np.uint8), stats, [np.arange(63.0)])

    def impurity(mine):
        mass, ones = weight[mine].sum(), (weight * y)[mine].sum()
        return 2 * ones * (mass - ones) / mass

    by_cut = [impurity(bins <= c) + impurity(bins > c) for c in range(8)]
    assert grown.cut[0] == int(np.argmin(by_cut)) and grown.node.tolist() == [1, 2, 3]
    for place, mine in ((1, bins <= grown.cut[0]), (2, bins > grown.cut[0])):
        assert grown.value[place] == pytest.approx(np.average(y[mine], weights=weight[mine]))


def test_extra_trees_draw_thresholds_and_average_exactly():
    """Thresholds differ between trees, lie inside the node and need not be best; leaves are the exact means of their rows."""
    rng = np.random.default_rng(2)
    bins, y = rng.integers(0, 64, (4_000, 2)).astype(np.uint8), rng.normal(size=4_000).round(4)
    learner = Learner("extra_trees", 40, 6, "all", regression=True)
    stats = trees.statistics(learner, trees.copies(learner, 0, np.arange(4_000)), y, np.ones(4_000))
    edges = [np.arange(63.0), np.arange(63.0) ** 3]
    grown = [trees.grow(learner, t, bins, stats, edges) for t in range(40)]
    first = [(int(g.column[0]), int(g.cut[0])) for g in grown]
    assert len(set(first)) > 20
    # Where edges grow cubed, a uniform draw between the outer ones falls among the last edges far more often.
    drawn = [trees._drawn(learner, t, np.array([1]), 1, np.ones((1, 64, 4), np.int64), edges[1])[0] for t in range(400)]
    assert 20 < 400 * (32 / 62) ** 3 * 0.6 < sum(d <= 32 for d in drawn) < 400 * (32 / 62) ** 3 * 1.5
    for one in grown[:5]:
        at = one.leaves(bins)
        assert (one.column[at] == -1).all()
        for leaf in np.unique(at):
            assert one.value[leaf] == pytest.approx(y[at == leaf].mean(), abs=1e-6)


def test_forests_sample_rows_and_columns():
    learner = Learner("forest", 9, 4)
    seen = trees.copies(learner, 3, np.arange(50_000))
    assert abs(seen.mean() - 1) < 0.02 and abs((seen == 0).mean() - np.exp(-1)) < 0.01
    assert (trees.copies(learner, 4, np.arange(50_000)) != seen).mean() > 0.5
    tried = trees._tried(learner, 0, np.arange(1, 4_001), 9)
    assert (tried.sum(axis=1) == 3).all() and (abs(tried.mean(axis=0) - 1 / 3) < 0.04).all()


def test_boosting_follows_its_definition():
    """Each leaf is a Newton step on the rows in it, from the log odds on."""
    rng = np.random.default_rng(3)
    bins, y, weight = rng.integers(0, 64, (500, 3)).astype(np.uint8), rng.integers(0, 2, 500).astype(float), rng.random(500) + 0.5
    learner = Learner("boosting", 3, 2, "all")
    grown = trees.boost(learner, bins, y, weight, [np.arange(63.0)] * 3)
    mean = np.average(y, weights=weight)
    margin = np.full(500, np.log(mean / (1 - mean)))
    for one in grown:
        p, at = 1 / (1 + np.exp(-margin)), one.leaves(bins)
        for leaf in np.unique(at):
            mine = at == leaf
            step = (weight * (y - p))[mine].sum() / (weight * p * (1 - p))[mine].sum()
            assert one.value[leaf] == pytest.approx(0.1 * step, abs=1e-5)
        margin = margin + one.value[at]


def test_logistic_gradients_vanish(spark):
    """At the solution the weights equal minus the gradient of the summed losses, for every fold and choice of columns."""
    x, y, values = table(spark)
    weight = 1 + (np.arange(len(y)) % 3) / 2
    folds, columns = (0, 1, 0), ((0, 1, 2, 3), (0, 1, 2, 3), (1, 3))
    betas = logistic.fit(values, logistic.Logistic(strength=0.5), folds, columns)
    for fold, chosen, beta in zip(folds, columns, betas):
        mine = np.arange(len(y)) % 2 != fold
        p = 1 / (1 + np.exp(-(x[mine][:, chosen] @ beta[:-1] + beta[-1])))
        slope = 0.5 * weight[mine] * (p - y[mine])
        assert np.allclose(x[mine][:, chosen].T @ slope + beta[:-1], 0, atol=1e-6) and abs(slope.sum()) < 1e-6


def test_cross_fit_scores_every_row_out_of_fold(spark):
    """Repeated rows, missing values, a constant column and a fold without rows."""
    rng = np.random.default_rng(4)
    rows = [(int(f), float(v), None if i % 9 == 0 else float(v) ** 2, 1.0, int(v > 0)) for i, (f, v) in enumerate(zip(rng.integers(1, 4, 300), rng.normal(size=300).round(1)))]
    cells = spark.createDataFrame(rows, "fold_id long, a double, b double, c double, player_present long")
    learners = {"logistic": models.Logistic(), "forest": Learner("forest", 3, 4), "extra_trees": Learner("extra_trees", 3, 4), "boosting": Learner("boosting", 3, 3, "all")}
    scored = models.cross_fit(cells, ["a", "b", "c"], learners, settings={"whole": None, "most": 0.9}, keep=["a"], folds=(1, 2, 3, 4))
    found = scored.collect()
    assert len(found) == len(rows) * 8 and all(0 <= r["p"] <= 1 for r in found)
    by_model = models.fold_metrics(scored).collect()
    assert len(by_model) == 8 * 3 and min(r["accuracy"] for r in by_model if r["model"] in ("logistic", "boosting")) > 0.9


def test_counts_of_all_models(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{i}", int(i % 4) + 1, int(c), float(c) + rng.normal() / 5, None) for i, c in enumerate(rng.integers(0, 9, 160))]
    images = spark.createDataFrame(rows, "image string, fold_id long, count long, a double, b double")
    found = models.cross_fit_counts(images, {n: Learner(m.kind, 8, 5, "all", regression=True, rate=0.5) for n, m in models.count_learners().items()}, ["a", "b"]).collect()
    assert len(found) == 3 * 160
    off = {m: np.mean([abs(r["predicted"] - r["count"]) for r in found if r["model"] == m]) for m in ("forest", "extra_trees", "boosting")}
    assert max(off.values()) < 1


def test_equal_rows_are_one_with_a_count(spark):
    """A tree cannot tell equal rows apart: they are packed once, whatever their number, and drawn as often as single rows would be."""
    data = [(0, i, True, float(i % 2), 1.0, [float(i % 4), 1.0]) for i in range(800)]
    values = spark.createDataFrame(data, "fold int, id long, train boolean, y double, weight double, x array<double>")
    edges = trees.column_edges(values, 2)
    own = [Experiment("forest", "whole", 0, (0,), Learner("forest", 3, 2))]
    grouped = trees._grouped(trees.binned(values, edges), [(0,)], own).collect()
    assert len(grouped) == 4 and {r["n"] for r in grouped} == {200} and len({r["id"] for r in grouped}) == 4
    ids = np.arange(20_000)
    for n in (1, 2, 30, 5_000):
        seen = trees.copies(own[0].learner, 1, ids, np.full(len(ids), n))
        assert abs(seen.mean() / n - 1) < 4 / np.sqrt(n * len(ids)) and abs(seen.var() / n - 1) < 0.06
    assert trees.copies(own[0].learner, 1, ids, np.ones(len(ids), np.int64)).tolist() == trees.copies(own[0].learner, 1, ids).tolist()


def test_boosting_of_counts_is_boosting_of_repeated_rows():
    rng = np.random.default_rng(6)
    bins, y, weight, n = rng.integers(0, 64, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300).astype(float), np.ones(300), rng.integers(1, 5, 300)
    learner, edges = Learner("boosting", 4, 3, "all"), [np.arange(63.0)] * 3
    counted = trees.boost(learner, bins, y, weight, edges, n)
    repeated = trees.boost(learner, *(np.repeat(v, n, axis=0) for v in (bins, y, weight)), edges)
    for a, b in zip(counted, repeated):
        assert a.node.tolist() == b.node.tolist() and a.column.tolist() == b.column.tolist() and np.allclose(a.value, b.value, atol=1e-4)


def test_settings_of_the_same_columns_are_fitted_once(spark, monkeypatch):
    """Two shares that keep the same components are one experiment with two names."""
    rng = np.random.default_rng(10)
    rows = [(i % 2 + 1, float(v), float(w), int(v + w > 0)) for i, (v, w) in enumerate(rng.normal(size=(200, 2)).round(1))]
    cells = spark.createDataFrame(rows, "fold_id long, a double, b double, player_present long")
    asked, fitted = [], trees.fit
    monkeypatch.setattr(trees, "fit", lambda rows_, own, edges: asked.append(len(own)) or fitted(rows_, own, edges))
    scored = models.cross_fit(cells, ["a", "b"], {"forest": Learner("forest", 2, 3)}, settings={"most": 0.999, "nearly": 0.9999}, folds=(1, 2))
    found = {(r["pca"], r["fold_id"]): r["accuracy"] for r in models.fold_metrics(scored).collect()}
    assert asked == [2] and len(found) == 4 and scored.count() == 400
    assert all(found["most", f] == found["nearly", f] for f in (1, 2))


@pytest.mark.parametrize("kind", ["forest", "extra_trees"])
def test_a_level_counts_as_often_as_a_node_tries_columns(monkeypatch, kind):
    """Each pass takes one tried column of every node, so wide tables cost what is tried, not all columns; counts by definition."""
    random = np.random.default_rng(4)
    bins = random.integers(0, trees.BINS, (400, 30)).astype(np.uint8)
    slot, stats = random.integers(0, 6, 400), random.integers(0, 5, (3, 400)).astype(float)
    learner, nodes = trees.Learner(kind, 1, 6), np.arange(8, 14)
    found = list(trees._histograms(learner, 3, nodes, slot, np.ascontiguousarray(bins.T), stats))
    tried = trees._tried(learner, 3, nodes, 30)
    assert len(found) == 5 and all(set(np.flatnonzero(tried[n])) == {int(own[n]) for own, _ in found} for n in range(6))
    for own, histogram in found:
        for n in range(6):
            mine = slot == n
            expected = [np.bincount(bins[mine, own[n]], part[mine], trees.BINS) for part in stats]
            assert (histogram[n] == np.stack(expected, axis=1)).all()

    edges = [np.sort(random.standard_normal(int(n))) for n in random.integers(0, 64, 30)]
    table = trees._edge_table(edges)
    for own, histogram in found:
        drawn = trees._drawn_cuts(learner, 3, nodes, own, histogram, *table)
        for n in range(6):
            held = np.flatnonzero(histogram[n, :, 0])
            low, high, mine = held.min(), held.max(), edges[own[n]]
            if not len(mine):
                assert drawn[n] == 0
                continue
            least, most = mine[min(low, len(mine) - 1)], mine[min(max(high - 1, 0), len(mine) - 1)]
            value = least + trees._uniform(learner.seed + 2, 3, nodes[n], own[n]) * (most - least)
            assert drawn[n] == np.clip(np.searchsorted(mine, value, "left"), low, max(high - 1, low))

    counted, plain = [], trees._histogram
    monkeypatch.setattr(trees, "_histogram", lambda *given: counted.append(1) or plain(*given))
    y = random.random(400)
    trees.grow(learner, 0, bins, trees.statistics(learner, np.ones(400, np.int64), y, np.ones(400)), [np.arange(63.0)] * 30)
    assert len(counted) <= 5 * learner.depth
