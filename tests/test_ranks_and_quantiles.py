import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestline.functions.quantiles import exact_mode, exact_quantiles
from harvestline.functions.ranking import hash_rank, value_rank
from harvestline.operators import sampling as P
from harvestline.plans import validation as V


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third of them with one value, one far outlier."""
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.67, "hot", rng.choice(list("abc"), n)), "v": np.round(rng.normal(size=n), 3)})
    pdf.loc[rng.random(n) < 0.33, "v"] = 0.5
    pdf.loc[0, "v"] = 1e12
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, "v", {"q1": 0.25, "med": 0.5, "q9": 0.9, "hi": 1.0}, ["g"], std="sd").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        want = np.quantile(part.v, [0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got.loc[g, ["q1", "med", "q9", "hi"]].astype(float), want)
        assert np.isclose(got.loc[g, "sd"], np.std(part.v)) and got.loc[g, "n"] == len(part)


def test_quantiles_without_group_and_with_null_group(spark, skewed):
    pdf, df = skewed
    assert np.isclose(exact_quantiles(df, "v", {"med": 0.5}).first().med, pdf.v.median())
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0), ("x", None)], "g string, v double")
    out = {r.g: (r.med, r.n) for r in exact_quantiles(nulls, "v", {"med": 0.5}, ["g"]).collect()}
    assert out == {None: (2.0, 2), "x": (5.0, 1)}


def test_fixture_quartiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 5, 9, 11, 4]], "v double")
    r = exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}, std="sd").first()
    assert (r.q1, r.m, r.q3) == (2.0, 4.0, 7.0) and abs(r.sd - 3.5225222874) < 1e-9


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "v int")
    assert exact_mode(df, "v").first().mode == 1


def test_ranks_are_permutations(skewed):
    pdf, df = skewed
    by_value = value_rank(df, "v", ["id"], 1).toPandas().sort_values("rank")
    assert list(by_value["rank"]) == list(range(1, len(pdf) + 1))
    assert by_value.v.is_monotonic_increasing
    by_hash = hash_rank(df, ["id"], 1, by=["g"]).toPandas()
    for _, part in by_hash.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_samples_have_exact_sizes_and_repeat(skewed):
    pdf, df = skewed
    low = P.lowest_fraction(df, "v", "id", 0.4).toPandas()
    assert len(low) == round(len(pdf) * 0.4) and low.v.max() <= np.sort(pdf.v)[round(len(pdf) * 0.4) - 1]
    a = {r.id for r in P.random_fraction(df, ["id"], 0.1, 3).collect()}
    b = {r.id for r in P.random_fraction(df.repartition(3), ["id"], 0.1, 3).collect()}
    assert a == b and len(a) == round(len(pdf) * 0.1)


def test_cap_per_group_keeps_small_groups_whole(skewed):
    pdf, df = skewed
    sizes = P.cap_per_group(df, ["g"], "id", 500).groupBy("g").count().toPandas().set_index("g")["count"]
    for g, n in pdf.g.value_counts().items():
        assert sizes[g] == min(n, 500)


def test_large_caps_keep_the_same_rows(skewed):
    pdf, df = skewed
    big = {r.id for r in P.cap_per_group(df, ["g"], "id", 1500).collect()}
    again = {r.id for r in P.cap_per_group(df.repartition(3), ["g"], "id", 1500).collect()}
    assert big == again and len(big) == sum(min(n, 1500) for n in pdf.g.value_counts())


def test_cap_is_applied_before_the_shuffle(skewed):
    plan = P.cap_per_group(skewed[1], ["g"], "id", 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # two rounds, each limited before and after its shuffle


def test_folds_partition_the_rows(skewed):
    pdf, df = skewed
    sizes = V.folds_kfold(df, ["id"], 7).groupBy("fold").count().toPandas()["count"]
    assert sizes.sum() == len(pdf) and sizes.max() - sizes.min() <= 1
    ts = V.folds_time_series(df, "v", ["id"], 3).toPandas()
    for _, part in ts.groupby("fold"):
        train, test = part[part.role == "train"], part[part.role == "test"]
        assert len(test) == len(pdf) // 4 and train.v.max() <= test.v.min()


def test_roles_cover_eligible_rows(spark):
    df = spark.createDataFrame([(c, y) for c in ("UA", "AT", "DE") for y in range(2015, 2024)], "country string, c_year int")
    for mode in V.MODES:
        out = V.train_roles(df, "UA", mode, 2020, exclude_years=[2022]).toPandas()
        assert not ((out.role != "test") & out.c_year.isin([2020, 2022])).any()
        test = out[out.role == "test"]
        assert set(zip(test.country, test.c_year)) == {("UA", 2020)}
        if mode in ("transfer", "direct"):
            assert (out[out.role == "train"].country != "UA").all()


def test_guards_drop_small_folds(spark):
    rows = [(1, "train")] * 5 + [(1, "test")] * 2 + [(2, "train")] * 1 + [(2, "test")] * 2
    out = V.fold_guards(spark.createDataFrame(rows, "fold int, role string"), {"train": 3, "test": 1})
    assert {r.fold for r in out.collect()} == {1}


def test_an_outlier_leaves_no_crowded_part(spark):
    from harvestline.functions.ranking import with_bucket, with_part

    values = [(290 + 20 * k / 200_000,) for k in range(200_000)] + [(1e9,)]
    counts = spark.createDataFrame(values, "v double").withColumn("_g", F.struct(F.lit(0).alias("all")))
    crowded = with_bucket(counts, F.col("v"))
    assert crowded.groupBy("_bucket").count().count() < 50
    parts = with_part(crowded, F.col("v")).groupBy("_bucket", "_part").count()
    assert parts.agg(F.max("count")).first()[0] < 200_000 / 1000
    assert abs(exact_quantiles(counts.drop("_g"), "v", {"m": 0.5}).first().m - 300) < 1e-3


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_years_are_reduced_before_they_meet(spark, capsys):
    from harvestline.operators.sets import intersect_years

    years = lambda *v: spark.createDataFrame([(y,) for y in v], "c_year int")
    out = intersect_years(years(1, 1, 2, None), years(1, 2, 2, 3, None))
    assert sorted(str(r.c_year) for r in out.collect()) == ["1", "2", "None"]
    plan = plan_of(out, capsys)
    assert plan[plan.index("Join"):].count("Aggregate") >= 4, plan  # both sides, before and after their shuffles


def test_few_groups_meet_their_statistics_in_parts(spark, capsys):
    """One crop and one fraction: neither the crop's mean nor the group's range gathers the rows."""
    from harvestline.functions.ranking import with_bucket
    from harvestline.operators.scores import sample_fraction_curve

    rows = [(1, "A", float(k)) for k in range(1, 1000)] + [(2, None, 5.0), (2, None, 15.0), (2, "B", None)]
    scores = spark.createDataFrame(rows, "fraction int, crop string, score double")
    found = {r.fraction: r for r in sample_fraction_curve(scores).collect()}
    assert abs(found[1].median - 1) < 1e-12 and abs(found[1]["mean"] - 1) < 1e-12 and found[1].n == 999
    assert abs(found[2].median - 1) < 1e-12 and abs(found[2]["std"] - 0.5) < 1e-12 and found[2].n == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_part" in plan_of(sample_fraction_curve(scores), capsys)
        counts = scores.where("score is not null").select(F.struct("fraction").alias("_g"), F.col("score").alias("_v"))
        placed = with_bucket(counts, F.col("_v"), sums={"_sv": F.col("_v")})
        assert placed.where("_g.fraction = 1").select("_sv").distinct().collect() == [(999 * 500.0,)]
        assert placed.where("_g.fraction = 1").agg(F.min("_bucket"), F.max("_bucket")).first() == (0, 4095)
        assert "hashpartitioning(_g" in (plan := plan_of(placed, capsys)) and "_salt" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
