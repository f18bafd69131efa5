import datetime as dt
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass import EngineConfig
from dayglass.functions import expressions as X
from dayglass.operators import explain, forest, peers, stats
from dayglass.plans import risk_model

DAY = dt.date(2024, 1, 1)


# ---- medians ---------------------------------------------------------------------------
@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9 + [1.0], [0.0, 0.0, 0.0, 7.0], list(range(1, 1001))])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    row = stats.exact_median(df, F.col("x")).first()
    assert (row.n, row.median) == (len(values), statistics.median(values))


def test_exact_median_grouped(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([0.0, rng.gauss(0, 1), rng.expovariate(1)])) for g in "abc" for _ in range(rng.randrange(50, 400))]
    data += [("hot", float(i % 7)) for i in range(2000)]
    got = {r.g: r.median for r in stats.exact_median(spark.createDataFrame(data, "g string, x double"), F.col("x"), ["g"]).collect()}
    for g in ("a", "b", "c", "hot"):
        assert got[g] == pytest.approx(statistics.median(x for k, x in data if k == g))


@pytest.mark.parametrize("values,scale", [([1.0, 2.0, 3.0], 1.4826), ([1.0, 1.0, 1.0, 5.0], statistics.pstdev([1, 1, 1, 5])), ([2.0, 2.0], 1.0), ([3.0], 1.0)])
def test_robust_scale(spark, values, scale):
    row = stats.robust_baseline(spark.createDataFrame([(v,) for v in values], "x double"), F.col("x")).first()
    assert row.scale == pytest.approx(scale)


# ---- expressions -------------------------------------------------------------------------
def test_tiers(spark, cfg):
    scores = [0.0, 39.999, 40.0, 65.0, 85.0, 100.0, 101.0, -1.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(X.risk_tier(F.col("s"), cfg)).collect()]
    assert got == ["Low", "Low", "Medium", "High", "Critical", "Critical", "Critical", "Critical", "Critical", None]


def test_score_properties(spark):
    df = spark.range(0, 400).select((F.col("id") / 10 - 5).alias("raw"))
    got = [r[0] for r in df.select(X.excess_score(F.col("raw"), F.lit(2.0), F.lit(0.0), 2.5).alias("s"), "raw").orderBy("raw").collect()]
    assert all(0 <= a <= b <= 100 for a, b in zip(got, got[1:])) and got[0] == 0.0


def test_compress(spark):
    zs = [-40.0, -15.0, -1.0, 0.0, 15.0, 16.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(X.compress_z(F.col("z"), 15.0)).collect()]
    assert got == pytest.approx([-(15 + math.log1p(25)), -15.0, -1.0, 0.0, 15.0, 15 + math.log1p(1)])


# ---- peers -------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    rows = []
    for role, n in (("a", 300), ("b", 200), ("solo", 1)):
        mix = rng.normal(size=(3, 3))
        for i, x in enumerate(rng.normal(size=(n, 3)) @ mix + 3):
            rows.append((f"{role}{i}", DAY, role, *map(float, x)))
    return spark.createDataFrame(rows, "user_id string, day date, role string, f double, g double, h double")


def test_mahalanobis_against_numpy(matrix, cfg):
    cols = ["f", "g", "h"]
    roles = peers.role_moments(matrix, cols, cfg)
    got = {r.user_id: r.peer_distance for r in peers.with_distance(matrix, cols, roles).collect()}
    data = matrix.toPandas()
    whole = np.cov(data[cols].to_numpy(), rowvar=False)
    for role, part in data.groupby("role"):
        x = part[cols].to_numpy()
        cov = np.cov(x, rowvar=False) if len(x) > 1 else whole  # one-row role: population covariance
        inv = np.linalg.inv(cov + cfg.ridge * np.eye(3))
        d = x - x.mean(axis=0)
        want = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inv, d), 0))
        assert [got[u] for u in part["user_id"]] == pytest.approx(list(want), abs=1e-9)


def test_unseen_role_has_no_peer_score(spark, matrix, cfg):
    model = peers.fit_peers(matrix.where("role <> 'solo'"), ["f", "g", "h"], cfg)
    scored = peers.peer_score(matrix, ["f", "g", "h"], model, cfg)
    assert scored.where("role = 'solo' AND peer_group_score IS NULL").count() == 1
    low, high = scored.where("role <> 'solo'").agg(F.min("peer_group_score"), F.max("peer_group_score")).first()
    assert 0 <= low < high <= 100


# ---- explanation ---------------------------------------------------------------------------
def test_contributions(spark):
    cfg = EngineConfig(weights=(1.0, 2.0, 1.0))
    df = spark.createDataFrame([("u", DAY, "r", 1.0, 1.0, 500.0), ("v", DAY, "r", 0.0, 0.0, 0.0), ("w", DAY, "?", 0.0, 0.0, 0.0)],
                               "user_id string, day date, role string, f double, g double, h double")
    model = spark.createDataFrame([("r", [0.0] * 3, [1.0, 1.0, 0.0], [1.0, 1.0, 10.0])],
                                  "role string, mean array<double>, std array<double>, population_std array<double>")
    got = {r.user_id: r.top_features for r in explain.explain(df, ["f", "g", "h"], model, cfg, 3).collect()}
    u = got["u"]
    assert [p.feature for p in u] == ["h", "g", "f"]
    assert u[0].z_score == pytest.approx(500 / 1.5, abs=0.01) and u[0].z_capped_for_display
    assert sum(p.pct_contribution for p in u) == pytest.approx(100, abs=0.2)
    # no deviation at all: shares are 0 and ties keep feature order
    assert [(p.feature, p.pct_contribution, p.direction) for p in got["v"]] == [(f, 0.0, "below peer norm") for f in "fgh"]
    assert got["w"] is None


# ---- forest --------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    rows = [(i, DAY, *map(float, x)) for i, x in enumerate(rng.normal(size=(1500, 3)))] + [(9999, DAY, 40.0, -40.0, 40.0)]
    return spark.createDataFrame(rows, "user_id bigint, day date, f double, g double, h double")


def fit(df, cfg):
    return forest.fit_forest(df, ["f", "g", "h"], ["user_id", "day"], df.count(), cfg).toPandas().sort_values(["tree_id", "node_id"])


def test_forest_is_independent_of_partitioning(cloud):
    cfg = EngineConfig(n_trees=20)
    a, b = fit(cloud.repartition(3), cfg), fit(cloud.repartition(7), cfg)
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True))


def test_forest_samples(cloud):
    cfg = EngineConfig(n_trees=20)
    sizes = forest.tree_samples(cloud, ["f"], ["user_id", "day"], 1501, cfg).groupBy("tree_id").count().collect()
    assert len(sizes) == 20 and all(r["count"] == 256 for r in sizes)
    few = forest.tree_samples(cloud.limit(40), ["f"], ["user_id", "day"], 40, cfg).groupBy("tree_id").count().collect()
    assert all(r["count"] == 40 for r in few)


def test_forest_samples_a_large_table(spark):
    """With more rows than the pool takes, every tree still gets its full sample."""
    cfg = EngineConfig(n_trees=5, tree_rows=32)
    df = spark.range(50_000).select(F.col("id").alias("user_id"), F.lit(DAY).alias("day"), F.rand(1).alias("f"))
    sizes = forest.tree_samples(df, ["f"], ["user_id", "day"], 50_000, cfg).groupBy("tree_id").count().collect()
    assert len(sizes) == 5 and all(r["count"] == 32 for r in sizes)


@pytest.mark.parametrize("n", [12, 90])  # every row enters every tree, or some do
def test_forest_samples_by_hand(spark, n):
    cfg = EngineConfig(n_trees=13, tree_rows=5)
    df = spark.range(n).select(F.col("id").alias("user_id"), F.lit(DAY).alias("day"), (F.col("id") * 2.0).alias("f"))
    drawn = forest.tree_samples(df, ["f"], ["user_id", "day"], n, cfg)
    assert "lambda" not in drawn._jdf.queryExecution().executedPlan().toString()  # pairs of row and tree are plain rows
    chance, want = forest.draw_chance(n, 5), []

    def number(digest, place):
        return int(digest[place * 12:place * 12 + 12], 16) / 16**12

    entered = {t: [] for t in range(13)}
    for i in range(n):
        name = f"{cfg.seed}|{i}|{DAY}"
        u = number(hashlib.sha256(name.encode()).hexdigest(), 0)
        first = next((t for t in range(13) if u < 1 - (1 - chance) ** (t + 1)), 13)
        for t in range(first, 13):
            own = number(hashlib.sha256(f"{name}|{t // 5}".encode()).hexdigest(), t % 5)
            if t == first or own < chance:
                entered[t].append((own * chance if t == first else own, i))
    for t, found in entered.items():
        want += [(t, place, 2.0 * i) for place, (_, i) in enumerate(sorted(found)[:5], 1)]
    assert sorted(map(tuple, drawn.collect())) == want


def test_planted_outlier_ranks_first(spark, cloud):
    cfg = EngineConfig(n_trees=100)
    score = forest.forest_score(fit(cloud, cfg), [F.col(c) for c in "fgh"], 256, spark)
    ranked = cloud.withColumn("s", score).orderBy(F.col("s").desc()).select("user_id", "s").collect()
    assert ranked[0].user_id == 9999 and all(0 < r.s < 1 for r in ranked)


def test_descent_matches_recursion():
    x = np.random.default_rng(0).normal(size=(200, 3))
    import pandas as pd

    nodes = [(0, *n) for n in forest.grow_tree(x[:64], 1, 0, 6)]
    table = pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "threshold", "rows", "depth"])
    packed = forest.pack_forest(table, 64)
    tree = {n[1]: n for n in nodes}

    def path(row, node=0):
        _, _, feature, cut, size, depth = tree[node]
        if feature < 0:
            return depth + float(forest.mean_path(size))
        return path(row, 2 * node + 1 + int(row[feature] > cut))

    want = [2 ** (-path(r) / float(forest.mean_path(64))) for r in x]
    assert forest.anomaly(packed, x) == pytest.approx(want)


def test_descent_by_place_is_descent_by_value():
    """Values at a cut, beyond all cuts and no number take the same way as compared themselves."""
    import pandas as pd

    nodes = [(0, *n) for n in forest.grow_tree(np.random.default_rng(0).normal(size=(64, 3)), 1, 0, 6)]
    packed = forest.pack_forest(pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "threshold", "rows", "depth"]), 64)
    tree = {n[1]: n for n in nodes}

    def path(row, node=0):
        _, _, feature, cut, size, depth = tree[node]
        return depth + float(forest.mean_path(size)) if feature < 0 else path(row, 2 * node + 1 + int(row[feature] > cut))

    odd = np.array([[v] * 3 for v in (*[n[3] for n in nodes if n[2] >= 0], np.inf, -np.inf, np.nan)])
    assert forest.anomaly(packed, odd) == pytest.approx([2 ** (-path(r) / float(forest.mean_path(64))) for r in odd])
    assert packed.place.dtype == np.int32 and all((np.diff(c) > 0).all() for c in packed.cuts)


# ---- whole model -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def detection(inputs, spark):
    cfg = inputs.cfg.with_(n_trees=40)
    out = risk_model.run_detection(inputs.activity, inputs.directory, inputs.answers, cfg)
    return {**out, "scored": risk_model.materialize(out["scored"], "scored")}


def test_scored_table(detection):
    scored = detection["scored"]
    bad = scored.where("NOT (risk_score BETWEEN 0 AND 100) OR size(top_features) <> 4").count()
    assert bad == 0 and scored.count() == 397
    blend = scored.where(F.abs(F.col("risk_score") - (F.col("isolation_forest_score") + F.col("peer_group_score")) / 2) > 1e-9)
    assert blend.count() == 0


def test_unseen_roles_go_to_the_reject_table(spark, detection):
    odd = detection["features"].limit(3).withColumn("role", F.lit("new role"))
    model = detection["model"]
    assert risk_model.rejects(model.transform(odd)).count() == 3
    partial = risk_model.RiskModel(model.cfg.with_(allow_partial=True), model.scaler, model.nodes, model.forest_fit, model.roles)
    assert risk_model.rejects(partial.transform(odd)).count() == 0


def test_save_and_load(spark, detection, tmp_path):
    folder = str(tmp_path / "model")
    assert detection["model"].save(folder) == 1
    again = risk_model.RiskModel.load(spark, folder)
    assert again.cfg == detection["model"].cfg
    a, b = (m.transform(detection["features"]).select("user_id", "day", "risk_score", "risk_tier") for m in (detection["model"], again))
    assert a.exceptAll(b).count() == 0


def test_a_loaded_model_prices_new_sessions(spark, detection, inputs, tmp_path):
    """Priced from raw activity, the sessions of the fitting run get the scores they had."""
    folder = str(tmp_path / "model")
    detection["model"].save(folder)
    again = risk_model.RiskModel.load(spark, folder)
    columns = ["user_id", "day", F.round("risk_score", 6).alias("s"), "risk_tier", "top_features"]
    priced = risk_model.materialize(again.price(inputs.activity, inputs.directory, inputs.answers).select(*columns), "priced")
    want = detection["scored"].select(*columns)
    assert priced.count() == want.count() and priced.exceptAll(want).count() == 0
    unseen = inputs.activity.where("user_id % 2 = 0")
    some = again.price(unseen, inputs.directory, inputs.answers).select("user_id", "day", F.round("risk_score", 6).alias("s"))
    assert some.exceptAll(want.where("user_id % 2 = 0").select("user_id", "day", "s")).count() == 0
    again.bigrams = None
    with pytest.raises(ValueError, match="pair counts"):
        again.price(inputs.activity, inputs.directory, inputs.answers)


def test_versions_and_torn_models(spark, tmp_path):
    import glob
    import os

    from dayglass.plans import model_store

    folder = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        model_store.read(spark, folder)
    rows = lambda n: spark.range(n).selectExpr("id AS a", "string(id) AS b")
    assert [model_store.publish(spark, folder, {"x": rows(n), "y": rows(0)}, {"n": n}) for n in (5, 7)] == [1, 2]
    parts, settings = model_store.read(spark, folder)
    assert settings == {"n": 7} and parts["x"].count() == 7 and parts["y"].count() == 0
    parts, settings = model_store.read(spark, folder, 1)
    assert settings == {"n": 5} and parts["x"].count() == 5

    rows(9).write.parquet(f"{folder}/parts/unfinished/x")  # a save that broke off before its manifest
    assert model_store.read(spark, folder)[1] == {"n": 7}
    ident = {r.version: r.ident for r in model_store.manifests(spark, folder).collect()}
    rows(1).write.mode("append").parquet(f"{folder}/parts/{ident[2]}/x")  # something else was written there
    with pytest.raises(model_store.TornModel, match="part x of version 2"):
        model_store.read(spark, folder)
    for file in glob.glob(f"{folder}/parts/{ident[1]}/y/*.parquet"):
        os.truncate(file, 3)
    with pytest.raises(model_store.TornModel, match="part y of version 1"):
        model_store.read(spark, folder, 1)


def test_stream_scoring_equals_batch(spark, detection, inputs, tmp_path):
    from dayglass.streaming import scoring

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    detection["features"].repartition(3).write.parquet(src)
    feed = spark.readStream.schema(detection["features"].schema).option("maxFilesPerTrigger", 1).parquet(src)
    scored = scoring.score_stream(feed, detection["model"])
    query = (scoring.decide_stream(scored, inputs.entitlements, detection["model"], out)
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    got = spark.read.parquet(f"{out}/decisions").select("user_id", "day", F.round("risk_score", 6).alias("s"), "risk_tier")
    want = detection["scored"].select("user_id", "day", F.round("risk_score", 6).alias("s"), "risk_tier")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
