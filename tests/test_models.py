import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestline.functions.metrics import score_columns
from harvestline.plans import explain, linear as LM, mlp, transfer as X, trees as M

FEATS = ["evi_LT2", "evi_LT1", "t2m_LT2", "t2m_LT1"]
KEYS = ["region_id", "c_year"]


@pytest.fixture(scope="module")
def panel(spark):
    """Planted signal: yield depends on two predictors, the others are noise."""
    rng = np.random.default_rng(11)
    rows = [(f"{c}{r:02d}", y, c) for c in ("UA", "AT", "DE", "FR") for r in range(12) for y in range(2010, 2018)]
    pdf = pd.DataFrame(rows, columns=["region_id", "c_year", "country"])
    for f in FEATS:
        pdf[f] = rng.normal(size=len(pdf))
    pdf["yield"] = 5 + 2 * pdf.evi_LT1 + np.maximum(pdf.t2m_LT1, 0) + np.where(pdf.country == "UA", 1.0, 0.0) + rng.normal(0, 0.1, len(pdf))
    return pdf, spark.createDataFrame(pdf)


def r2(df):
    return df.agg(score_columns("y_true", "y_pred")["r2"]).first()[0]


def test_linear_folds_equal_numpy(panel):
    pdf, df = panel
    got = LM.model_linear(df, FEATS).toPandas().set_index(KEYS).y_pred
    for year in (2010, 2014):
        tr, te = pdf[pdf.c_year != year], pdf[pdf.c_year == year]
        a = np.column_stack([np.ones(len(tr)), tr[FEATS]])
        beta = np.linalg.lstsq(a, tr["yield"], rcond=None)[0]
        want = np.column_stack([np.ones(len(te)), te[FEATS]]) @ beta
        assert np.allclose(got.loc[list(zip(te.region_id, te.c_year))], want)


def test_baseline_is_the_mean_of_the_other_years(panel):
    pdf, df = panel
    r = LM.model_baseline_mean(df).where("c_year = 2012").first()
    assert np.isclose(r.y_pred, pdf[pdf.c_year != 2012]["yield"].mean())


def test_network_learns_and_repeats(panel):
    _, df = panel
    job = mlp.Job("j", range(4), F.col("c_year") < 2016, hidden=(12, 6), epochs=60, rate=0.03, l2=0.0)
    a = mlp.fit_jobs(df, FEATS, "yield", [job])["j"]
    b = mlp.fit_jobs(df.repartition(5), FEATS, "yield", [job])["j"]
    assert a.history[-1] < 0.3 * a.history[0]
    assert np.allclose(a.layers[0][0], b.layers[0][0], atol=1e-6)
    preds = mlp.predict_jobs(df, FEATS, "yield", {"j": a}, {"j": F.col("c_year") >= 2016}, KEYS)
    assert preds.count() == 96 and r2(preds) > 0.8


def test_dropout_does_not_depend_on_batches(spark, panel):
    _, df = panel
    job = mlp.Job("j", range(4), F.col("c_year") < 2016, hidden=(12, 6), epochs=6, rate=0.03, dropout=0.3)
    a = mlp.fit_jobs(df, FEATS, "yield", [job])["j"]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        b = mlp.fit_jobs(df.repartition(3), FEATS, "yield", [job])["j"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert all(np.allclose(w, v, atol=1e-9) for (w, _), (v, _) in zip(a.layers, b.layers))


def test_sums_of_many_tasks(spark):
    from harvestline.plans.partials import sum_arrays

    df = spark.range(1000).repartition(100)
    got = sum_arrays(df, lambda b: {int(k): np.array([float(k), 1.0]) * int((b["id"].to_numpy() % 3 == k).sum()) for k in range(3)})
    assert {k: v.tolist() for k, v in got.items()} == {0: [0.0, 334.0], 1: [333.0, 333.0], 2: [666.0, 333.0]}


def test_linear_network_takes_the_steps_of_numpy(panel):
    """Adam on batches of 32 by hand, for a network without hidden layers."""
    pdf, df = panel
    job = mlp.Job("j", range(4), F.lit(True), hidden=(), epochs=3, rate=0.02, l2=0.01)
    net = mlp.fit_jobs(df, FEATS, "yield", [job])["j"]
    h = np.array([r.h for r in df.select(F.xxhash64(F.array(*FEATS), "yield").alias("h"), *KEYS).orderBy(*KEYS).collect()])
    rows = pdf.sort_values(KEYS).iloc[np.argsort(h)]
    x = ((rows[FEATS] - rows[FEATS].mean()) / rows[FEATS].std(ddof=0)).to_numpy()
    y = ((rows["yield"] - rows["yield"].mean()) / rows["yield"].std(ddof=0)).to_numpy()
    (w0, b0), = mlp._initial(job)
    theta, m, v, t = np.append(w0[:, 0], b0), np.zeros(5), np.zeros(5), 0
    for epoch in range(3):
        order = np.argsort(mlp._uniform(np.sort(h), 1, job.seed, epoch, 1 << 20)[:, 0], kind="stable")
        for at in range(0, len(order), 32):
            a, b = np.column_stack([x, np.ones(len(x))])[order[at:at + 32]], y[order[at:at + 32]]
            g = 2 * a.T @ (a @ theta - b) / len(b) + np.append(2 * 0.01 * theta[:4], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert np.allclose(np.append(net.layers[0][0][:, 0], net.layers[0][1]), theta, atol=1e-6)


def test_shards_come_near_a_single_one(monkeypatch, panel):
    """Averages over three shards give a loss within 15 % of batches over all rows after as many
    consecutive steps, three times the epochs; and the same weights however the table is partitioned."""
    _, df = panel
    jobs = lambda epochs: [mlp.Job(str(c), range(4), F.col("c_year") < 2016, F.col("c_year") == c, hidden=(12, 6), epochs=epochs, rate=0.01, l2=0.0,
                                   patience=200, plateau=200) for c in (2016, 2017)]
    whole = mlp.fit_jobs(df, FEATS, "yield", jobs(25))
    monkeypatch.setattr(mlp, "SHARD_BYTES", 384 * 4 * 8 // 3 + 1)
    a, b = mlp.fit_jobs(df, FEATS, "yield", jobs(75)), mlp.fit_jobs(df.repartition(5), FEATS, "yield", jobs(4))
    for name, net in whole.items():
        assert abs(min(a[name].history) - min(net.history)) < 0.15 * min(net.history)
        assert np.allclose(a[name].history[:4], b[name].history, atol=1e-6)


def test_networks_that_step_together_equal_single_ones(monkeypatch, panel):
    """A whole table, with steps of several networks at once; and each network has a task of its own."""
    _, df = panel
    jobs = [mlp.Job(str(c), range(k), F.col("c_year") < 2015, F.col("c_year") == c, hidden=(12, 6), epochs=6, rate=0.01, dropout=d)
            for c in (2015, 2016, 2017) for k, d in ((4, 0.0), (3, 0.0), (4, 0.2))]
    for i, j in enumerate(jobs):
        j.name, j.seed = f"{j.name}|{i}", i
    single = mlp.fit_jobs(df, FEATS, "yield", jobs)
    monkeypatch.setattr(mlp, "PIECE_BYTES", 1)
    monkeypatch.setattr(mlp, "CELLS", 1)
    together = mlp.fit_jobs(df, FEATS, "yield", jobs)
    for name, net in single.items():
        assert np.allclose(net.history, together[name].history, atol=1e-4)
        assert all(np.allclose(a, b, atol=1e-4) for (a, _), (b, _) in zip(net.layers, together[name].layers))
    table = mlp._training_table(df, FEATS, "yield", jobs)
    monkeypatch.setattr(mlp, "CELLS", 64)
    cells, groups = mlp._cells(table, 9, 1)
    held = cells.select("cell", F.spark_partition_id().alias("p")).distinct().collect()
    assert groups == 9 and len(held) == len({r.p for r in held}) == len({r.cell for r in held})


def test_copies_of_a_row_weigh_and_empty_jobs_are_left_out(panel):
    _, df = panel
    job = mlp.Job("j", range(4), F.col("country") == "UA", hidden=(6,), epochs=4, rate=0.01)
    none = mlp.Job("none", range(4), F.lit(False), hidden=(6,), epochs=4)
    copies = df.unionAll(df).unionAll(df)
    a, b = mlp.fit_jobs(df, FEATS, "yield", [job, none]), mlp.fit_jobs(copies, FEATS, "yield", [job])
    assert set(a) == {"j"}
    assert all(np.allclose(p, q, atol=1e-6) for (p, _), (q, _) in zip(a["j"].layers, b["j"].layers))
    assert mlp.fit_jobs(df.limit(0), FEATS, "yield", [job]) == {}


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    layers = [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 1)), rng.normal(size=1))]
    net = mlp.Net(layers, [0, 1, 2], np.zeros(3), np.ones(3), 0.0, 1.0)
    g = mlp._gradient(net, x, y, 0.0, np.arange(20), 1, 0)[:-1]
    flat = mlp._flat(layers)
    for i in (0, 5, 13, 17, len(flat) - 1):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        loss = lambda v: ((mlp.Net(mlp._unflat(v, layers), [0, 1, 2], np.zeros(3), np.ones(3), 0.0, 1.0).predict(x) - y) ** 2).sum()
        assert np.isclose(g[i], (loss(flat + d) - loss(flat - d)) / 2e-6, rtol=1e-4)


def test_frozen_layers_stay(panel):
    _, df = panel
    base = mlp.fit_jobs(df, FEATS, "yield", [mlp.Job("j", range(4), F.col("country") != "UA", hidden=(6, 4), epochs=5)])["j"]
    tuned = mlp.fit_jobs(df, FEATS, "yield", [mlp.Job("j", range(4), F.col("country") == "UA", hidden=(6, 4), epochs=5, start=base, trainable=1)])["j"]
    assert np.array_equal(base.layers[0][0], tuned.layers[0][0]) and np.array_equal(base.layers[1][0], tuned.layers[1][0])
    assert not np.array_equal(base.layers[2][0], tuned.layers[2][0])


def test_transfer_beats_source_only(panel):
    _, df = panel
    preds = X.transfer_learning(df.where("country <> 'UA'"), df.where("country = 'UA'"), FEATS, hidden=(12, 6), epochs=40, rate=0.03, tune_rate=0.01,
                                tune_epochs=30, with_boosted=False)
    s = score_columns("y_true", "y_pred")
    rmse = {r["model"]: r["rmse"] for r in preds.groupBy("model").agg(s["rmse"].alias("rmse")).collect()}
    assert set(rmse) == {"source", "transfer", "target_only"} and rmse["transfer"] < rmse["source"]


def test_grid_holds_out_the_target_year(panel):
    _, df = panel
    preds = X.loyo_grid(df, "UA", FEATS, feature_types=("full", "eo"), hidden=(6,), epochs=4, guards={"train": 10, "finetune": 5, "test": 1})
    pdf = preds.toPandas()
    assert (pdf.fold.astype(int) == pdf.c_year).all() and (pdf.region_id.str[:2] == "UA").all()
    assert len(pdf) == 2 * 3 * 12 * 8


def test_permutation_finds_the_planted_feature(panel):
    _, df = panel
    nets = mlp.fit_jobs(df, FEATS, "yield", [mlp.Job("j", range(4), F.col("c_year") < 2016, hidden=(12, 6), epochs=60, rate=0.03)])
    imp = explain.permutation_importance(df, nets, {"j": F.col("c_year") >= 2016}, FEATS, "yield", KEYS, repeats=4).toPandas().set_index("feature")
    assert imp.importance_mean.idxmax() == "evi_LT1" and imp.importance_mean["evi_LT1"] > 0.5
    assert abs(imp.importance_mean["evi_LT2"]) < 0.1 and (imp.importance_std >= 0).all()


def test_boosted_beats_the_mean(panel):
    _, df = panel
    assert r2(M.model_boosted(df, FEATS, F.col("c_year") == 2017, rounds=15)) > 0.5


def test_elimination_keeps_the_signal(panel):
    _, df = panel
    kept = {r.feature for r in M.rfe(df, FEATS, keep=2).where("selected").collect()}
    assert kept == {"evi_LT1", "t2m_LT1"}


def test_sizes_choose_parameters(spark):
    df = spark.createDataFrame([(50,), (100,), (499,), (500,)], "n_train int")
    assert [r.depth for r in M.size_adaptive_params(df).collect()] == [3, 4, 4, 6]
    assert M.params_for(150, M.SIZE_GRIDS)["rate"] == [0.1, 0.2]


def test_registered_searches_are_whole(monkeypatch):
    """Searches run with the library's draws and folds, all leads, all countries and the whole grid."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from harvestline.plans import boosting, transfer, trees, validation
    from harvestline.registry import base, q_models

    called = {}
    frame = MagicMock()
    frame.withColumn.return_value.select.return_value.distinct.return_value.collect.return_value = [("b",), ("a",), ("c",)]
    monkeypatch.setattr(base, "Views", lambda *_: SimpleNamespace(features=frame))
    monkeypatch.setattr(base, "_spark_col", lambda *_: None)
    monkeypatch.setattr(q_models, "admin_key", lambda *_: None)
    monkeypatch.setattr(validation, "folds_time_series", lambda *a, **k: called.setdefault("folds", a[-1]))
    for module, name in ((trees, "random_search"), (boosting, "grid_search_boosted"), (trees, "tuning_compare"), (transfer, "transfer_country_year")):
        monkeypatch.setattr(module, name, lambda *a, _n=name, **k: called.setdefault(_n, (a, k)) and frame)
        base.QUERIES[name.removesuffix("_boosted")](None, "")
    assert not {"draws", "folds"} & (called["random_search"][1].keys() | called["tuning_compare"][1].keys())
    assert called["tuning_compare"][0][2] == [1, 2, 3, 4] and called["transfer_country_year"][0][1] == ["a", "b", "c"]
    assert called["folds"] == 3 and [len(x) for x in called["grid_search_boosted"][0][2].values()] == [3, 3, 3]


def gappy(spark, n=240):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"region_id": [f"r{i}" for i in range(n)], "c_year": 2000 + np.arange(n) % 4, **{c: rng.normal(size=n) + 100 for c in FEATS}})
    pdf["yield"] = pdf.evi_LT1 * 2 - pdf.t2m_LT2 + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.2, "evi_LT1"] = np.nan
    return pdf, spark.createDataFrame(pdf).replace(float("nan"), None)


def test_least_squares_of_all_folds_take_their_sums_from_one_scan(spark, monkeypatch):
    pdf, df = gappy(spark)
    fits = []
    real = M.fit_predict
    monkeypatch.setattr(M, "fit_predict", lambda *a, **kw: fits.append(a[2]) or real(*a, **kw))
    sets = {"two": FEATS[:2], "all": FEATS}
    df = df.withColumn("copy", F.col("evi_LT2") * 2)
    out = M.leave_one_group(df, M.linear, sets, groups=[2000, 2001, 2003]).toPandas()
    assert not fits and len(out) == 2 * 180 and out.columns.tolist() == [*KEYS, "y_true", "y_pred", "setup", "fold"]
    for (setup, fold), got in out.groupby(["setup", "fold"]):
        train, test = pdf[pdf.c_year != fold], pdf[pdf.c_year == fold].set_index("region_id").loc[got.region_id]
        mean = train[sets[setup]].mean()
        x = lambda t: np.column_stack([np.ones(len(t)), t[sets[setup]].fillna(mean)])
        assert np.allclose(x(test) @ np.linalg.lstsq(x(train), train["yield"], rcond=None)[0], got.y_pred, atol=1e-6)
    # what the sums leave undetermined, and penalties, are fitted to the rows
    M.leave_one_group(df, M.linear, {"dependent": ["evi_LT2", "copy"]}, groups=[2000])
    M.leave_one_group(df, lambda: M.lasso(0.1), {"two": FEATS[:2]}, groups=[2000])
    assert fits == [["evi_LT2", "copy"], FEATS[:2]]


def test_search_prepares_each_fold_once(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import Imputer
    from pyspark.ml.tuning import CrossValidator

    _, df = gappy(spark)
    data = df.withColumn("label", F.col("yield")).withColumn("fold", F.col("c_year") - 2000).withColumn("fold", F.col("fold").cast("int")).coalesce(1)
    tree, maps = M.forest(3, 3), [{"maxDepth": 1}, {"maxDepth": 3}]
    cv = CrossValidator(estimator=M.scaled_fit(tree, FEATS), estimatorParamMaps=[{tree.maxDepth: m["maxDepth"]} for m in maps], numFolds=4,
                        foldCol="fold", evaluator=RegressionEvaluator(labelCol="label", predictionCol="y_pred", metricName="rmse"))
    wanted = cv.fit(data).avgMetrics
    fits, real = [], Imputer.fit
    monkeypatch.setattr(Imputer, "fit", lambda self, *a, **kw: fits.append(1) or real(self, *a, **kw))
    found = {r.setting: r.score for r in M._search(data, tree, maps, FEATS, "yield", "fold", 4, "rmse").collect()}
    assert len(fits) == 4 and np.allclose([found[0], found[1]], wanted, rtol=1e-9)
    with pytest.raises(ValueError):
        M._search(data, tree, maps, FEATS, "yield", "fold", 5, "rmse")


def test_leads_are_tuned_side_by_side(spark, monkeypatch):
    import threading

    _, df = gappy(spark)
    both = threading.Barrier(2)
    names = lambda d, known, keep, *a, **kw: both.wait(60) * 0 or spark.createDataFrame([(f, True) for f in known[:keep]], "feature string, selected boolean")
    monkeypatch.setattr(M, "rfe", names)
    out = M.tuning_compare(df.coalesce(1), FEATS, [1, 2], space={"maxDepth": [1, 2]}, draws=2, folds=2, keep=1, make=lambda: M.forest(2, 2)).collect()
    assert sorted((r.lead, r.setup, r.n) for r in out) == sorted((n, s, 240) for n in (1, 2) for s in ("default", "selected", "tuned", "both"))


def test_forest_keeps_the_nodes_of_rows(spark, monkeypatch):
    _, df = gappy(spark)
    df = df.coalesce(1)
    kept, real = [], M.fit_predict
    monkeypatch.setattr(M, "fit_predict", lambda data, estimator, *a, **kw: kept.append(estimator.getCacheNodeIds()) or real(data, estimator, *a, **kw))
    test = F.col("c_year") == 2003
    preds = lambda out: {r.region_id: r.y_pred for r in out.collect()}
    found = preds(M.model_forest(df, FEATS, test, trees=5))
    assert kept == [True] and found == preds(M.holdout(df, M.forest(5), FEATS, test)) and len(found) == 60


def test_fits_of_few_rows_have_few_tasks(spark, monkeypatch):
    _, df = gappy(spark)
    df, parts, real = df.repartition(6, "region_id"), [], M.fit_predict
    monkeypatch.setattr(M, "fit_predict", lambda data, *a, **kw: parts.append(data.rdd.getNumPartitions()) or real(data, *a, **kw))
    make = lambda: M.boosted(3)
    preds = lambda: {(r.region_id, r.setup, r.fold): r.y_pred for r in M.leave_one_group(df, make, {"two": FEATS[:2]}, groups=[2000, 2001]).collect()}
    few = preds()
    monkeypatch.setattr(M, "ROWS_PER_TASK", 1)
    many = preds()
    assert parts[:2] == [1, 1] and min(parts[2:]) > 1 and len(few) == 120 and few.keys() == many.keys()
    assert np.allclose([few[k] for k in few], [many[k] for k in few], rtol=1e-9)


def small_network(hidden=(8, 6), n=150, kind=float, **kw):
    rng = np.random.default_rng(8)
    x, h = rng.normal(size=(n, 4)), np.sort(rng.integers(-1 << 62, 1 << 62, n))
    job = mlp.Job("j", range(4), None, hidden=hidden, **kw)
    net = mlp.Net(mlp._initial(job), [0, 1, 2, 3], x.mean(0), x.std(0), 0.0, 1.0)
    return mlp.State(net, job, job.rate, False, keep=net.layers), mlp.Rows(net, x, x[:, 0] - x[:, 1], np.ones(n, np.int64) + (h % 3), h, kind)


@pytest.mark.parametrize("kw", [{}, {"dropout": 0.3}, {"trainable": 2}, {"optimizer": "sgd", "trainable": 1}, {"hidden": ()}, {"batch": 16}])
def test_steps_of_several_networks_are_those_of_one(kw):
    """Three epochs of the plain steps, and of the same network among others of its shape; one has fewer rows."""
    alone, rows = small_network(**kw)
    together = [small_network(**{**kw, "seed": 42 if i == 1 else i, "dropout": kw.get("dropout", 0.0) * (i != 2), "n": 70 if i == 2 else 150}) for i in range(3)]
    for epoch in range(3):
        mlp._epoch(alone, rows, epoch)
        mlp._epoch_together([s for s, _ in together], [r for _, r in together], epoch)
    same = together[1][0]
    assert alone.steps == same.steps and np.allclose(mlp._flat(alone.net.layers), mlp._flat(same.net.layers), atol=1e-10)
    assert np.allclose(alone.m, same.m, atol=1e-10) and (kw.get("optimizer") or np.allclose(alone.v, same.v, atol=1e-10))


def test_no_weight_stays_subnormal():
    state, rows = small_network(kind=np.float32)
    state.net.layers[0][0][:2], state.net.layers[1][0][3] = 3e-39, -2e-40
    state.rate = 1e-9
    mlp._epoch_together([state], [rows], 0)
    flat = np.abs(mlp._flat(state.net.layers)).astype(np.float32)
    assert not ((flat > 0) & (flat < np.finfo(np.float32).tiny)).any() and np.isfinite(flat).all()


def test_jobs_that_differ_in_name_only_share_a_network(panel, monkeypatch):
    _, df = panel
    trained, real = [], mlp._fit_group
    monkeypatch.setattr(mlp, "_fit_group", lambda d, f, y, jobs: trained.extend(j.name for j in jobs) or real(d, f, y, jobs))
    train = lambda c, y: X.role_conditions("all", c, y)["train"]
    jobs = [mlp.Job(f"{c}|{y}", range(4), train(c, y), hidden=(6,), epochs=2) for c in ("UA", "AT") for y in (2010, 2011)]
    jobs += [mlp.Job("text", range(4), F.col("c_year") == "1", epochs=2), mlp.Job("number", range(4), F.col("c_year") == 1, epochs=2)]
    nets = mlp.fit_jobs(df, FEATS, "yield", jobs)
    assert trained == ["UA|2010", "UA|2011", "text", "number"] and set(nets) == {j.name for j in jobs[:4]}
    alone = mlp.fit_jobs(df, FEATS, "yield", [jobs[2]])["AT|2010"]
    assert np.allclose(mlp._flat(nets["AT|2010"].layers), mlp._flat(alone.layers), atol=1e-9)


def test_packed_cells_hold_all_rows(panel):
    pdf, df = panel
    jobs = [mlp.Job(str(c), range(4), F.col("c_year") < 2016, F.col("c_year") == c) for c in (2016, 2017)]
    cells, groups = mlp._cells(mlp._training_table(df, FEATS, "yield", jobs), 2, 3, [0, 0])
    rows = [mlp._unpacked(r.data, r.rows, 4, 2) for r in mlp._packed(cells, 4, 2).collect()]
    assert groups == 1 and len(rows) == 3
    assert np.allclose(np.sort(np.concatenate([r[1] for r in rows])), np.sort(pdf["yield"]))
    assert sum((r[4] == 1).sum() for r in rows) == 2 * 288 and sum((r[4] == 2).sum() for r in rows) == 2 * 48
    assert all((np.diff(r[2]) > 0).all() and (r[3] == 1).all() and r[0].shape[1] == 4 for r in rows)


def test_fits_on_all_features_serve_where_all_are_selected(spark, monkeypatch):
    """At the last lead two features are known and two are kept; fits on all features go beside the selection."""
    import threading

    _, df = gappy(spark)
    both, sets, real = threading.Barrier(2), [], M.leave_one_group

    def names(d, known, keep, *a, **kw):
        if len(known) == 4:
            both.wait(60)
        return spark.createDataFrame([(f, True) for f in known[:keep]], "feature string, selected boolean")

    def folds(data, make, chosen, *a, **kw):
        (setup, cols), = chosen.items()
        sets.append((setup, len(cols)))
        if setup == "default" and len(cols) == 4:
            both.wait(60)
        return real(data, make, chosen, *a, **kw)

    monkeypatch.setattr(M, "rfe", names)
    monkeypatch.setattr(M, "leave_one_group", folds)
    out = M.tuning_compare(df.coalesce(1), FEATS, [1, 2], space={"maxDepth": [1, 2]}, draws=2, folds=2, keep=2, make=lambda: M.forest(2, 2)).toPandas()
    assert sorted(sets) == sorted([(s, 4) for s in ("default", "tuned")] + [(s, 2) for s in ("default", "tuned", "selected", "both")])
    assert sorted(zip(out.lead, out.setup, out.n)) == sorted((n, s, 240) for n in (1, 2) for s in ("default", "selected", "tuned", "both"))
    last = out[out.lead == 2].set_index("setup").ev
    assert last["selected"] == last["default"] and last["both"] == last["tuned"]
