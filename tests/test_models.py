"""Models against their own definitions: fitted optima, recomputed scores, pooled violators, folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.operators import evaluation, models
from leadloom.plans import registry
from leadloom.plans.adapters import Tables
from leadloom.plans.evaluation import FEATURES, _training

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return _training(Tables(spark, SF)).cache()


def plain_auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    return ((a > b) + (a == b) / 2).mean()


def test_baseline_is_the_weighted_optimum_and_scores_follow(spark, rows):
    train = rows.where("split = 'TRAIN'")
    model = models.train_lr(train, FEATURES, "target")
    scaler, lr = model.stages[2], model.stages[3]
    mean, std, beta, intercept = scaler.mean.toArray(), scaler.std.toArray().copy(), lr.coefficients.toArray(), lr.intercept
    d = train.toPandas()
    missing = d[FEATURES].astype(float).mean()
    std[std == 0] = np.inf  # a constant feature scales to zero
    d[FEATURES] = d[FEATURES].astype(float).fillna(missing)
    x, y = (d[FEATURES].to_numpy(float) - mean) / std, d.target.to_numpy(float)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    p = 1 / (1 + np.exp(-(x @ beta + intercept)))
    assert abs((w * (p - y)).sum() / w.sum()) < 1e-4  # the classes weigh the same
    centre = (w[:, None] * x).sum(0) / w.sum()
    spread = (w[:, None] * (x - centre) ** 2).sum(0) / w.sum()
    gradient = (w[:, None] * (p - y)[:, None] * x).sum(0) / w.sum() + 0.01 * spread * beta
    assert np.abs(gradient).max() < 1e-3

    got = {r.doc_id: r for r in registry.queries()["ml_score_batch"](spark, SF).collect()}
    every = rows.toPandas().set_index("doc_id")
    every[FEATURES] = every[FEATURES].astype(float).fillna(missing)
    scores = 1 / (1 + np.exp(-(((every[FEATURES].to_numpy(float) - mean) / std) @ beta + intercept)))
    assert set(got) == set(every.index)
    for doc_id, s in zip(every.index, scores):
        assert abs(got[doc_id].model_score - s) < 2e-6
    values = np.array([r.model_score for r in got.values()])
    for r in got.values():
        percentile = int(100 * (1 + (values < r.model_score).sum()) / len(values))
        assert (r.percentile, r.is_bottom, r.is_top) == (percentile, int(percentile <= 20), int(percentile >= 80))

    test = every[every.split == "TEST"]
    out = registry.queries()["ml_baseline"](spark, SF).first()
    assert abs(out.auc_roc - plain_auc(test.target, [got[i].model_score for i in test.index])) < 1e-5


def test_trees_repeat_and_stop_early(spark, rows):
    train, held = rows.where("split = 'TRAIN'"), rows.where("split = 'VALIDATION'")
    model = models.train(train, FEATURES, "target", validation=held)
    again = models.train(train, FEATURES, "target", validation=held)
    test = rows.where("split = 'TEST'")
    scored = models.score(model, test, FEATURES).toPandas()
    assert scored.model_score.tolist() == models.score(again, test, FEATURES).toPandas().model_score.tolist()
    assert 1 <= model.stages[1].getNumTrees <= 20
    out = registry.queries()["ml_train"](spark, SF).first()
    assert abs(out.auc_roc - plain_auc(scored.target, scored.model_score)) < 1e-5 and out.auc_roc >= 0.5
    weights = {r.target: r._weight for r in models.weighted(train, "target").select("target", "_weight").distinct().collect()}
    positive = train.agg({"target": "sum"}).first()[0]
    assert weights == {0: 1.0, 1: (train.count() - positive) / positive}


def test_search_means_over_the_folds(spark, rows):
    got = registry.queries()["ml_tune"](spark, SF).collect()
    assert [r.setting for r in got] == [0, 1]
    folded = rows.selectExpr("*", "doc_id % 3 as fold")
    found = []
    for k in range(3):
        model = models.train(folded.where(f"fold <> {k}"), FEATURES, "target", maxDepth=2, maxIter=5)
        s = models.score(model, folded.where(f"fold = {k}"), FEATURES).toPandas()
        found.append(plain_auc(s.target, s.model_score))
    assert abs(got[0].mean_auc - np.mean(found)) < 1e-5


def pooled(values, weights):
    """Pool adjacent violators."""
    blocks = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, n in blocks for _ in range(n)]


def test_calibration(spark):
    out = {r.method: r.brier for r in registry.queries()["ml_calibrate"](spark, SF).collect()}
    d = Tables(spark, SF).outcomes.select("score", "target").toPandas()
    bins = d.assign(b=np.floor(d.score * 1000)).groupby("b").agg(s=("score", "mean"), y=("target", "mean"), w=("target", "size"))
    fitted = np.interp(d.score, bins.s, pooled(bins.y.tolist(), bins.w.tolist()))
    assert abs(out["isotonic"] - ((fitted - d.target) ** 2).mean()) < 1e-5
    x, w = np.stack([np.ones(len(d)), d.score], axis=1), np.zeros(2)
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - d.target))
    assert abs(out["platt"] - (((1 / (1 + np.exp(-x @ w))) - d.target) ** 2).mean()) < 1e-5
    assert evaluation.calibration_error(Tables(spark, SF).outcomes, "target", "score").first().brier > out["isotonic"]


def test_halving_finds_the_winner_of_the_full_search(spark, rows):
    df = rows.withColumn("fold", F.col("doc_id") % 2)
    grid = [{"maxDepth": 1, "maxIter": 1}, {"maxDepth": 3, "maxIter": 4}, {"maxDepth": 1, "maxIter": 2}]
    full = {r.setting: r for r in models.tune(df, FEATURES[2:3], "target", "fold", grid).collect()}
    halved = {r.setting: r for r in models.tune(df, FEATURES[2:3], "target", "fold", grid, key="doc_id", shares=(0.5, 1.0)).collect()}
    best = lambda found: max(found.values(), key=lambda r: (r.share, r.mean_auc, -r.setting)).setting
    assert best(full) == best(halved) and halved[best(full)].mean_auc == full[best(full)].mean_auc
    assert sorted(r.share for r in halved.values()) == [0.5, 1.0, 1.0]


def test_learning_curve_on_nested_samples(spark, rows):
    train, valid = rows.where("split = 'TRAIN'"), rows.where("split = 'VALIDATION'")
    small, half = ({r.doc_id for r in models._placed(train, "doc_id", 7).where(F.col("_share") < s).collect()} for s in (0.2, 0.5))
    assert small < half
    got = {r.share: r for r in models.learning_curve(train, valid, FEATURES, "target", "doc_id", (0.2, 1.0), maxDepth=2, maxIter=2).collect()}
    assert (got[0.2].n, got[1.0].n) == (len(small), train.count()) and got[1.0].validation_auc > 0.5
