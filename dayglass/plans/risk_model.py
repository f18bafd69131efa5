"""Estimator and model: fit baselines on the training days, score every session."""

from __future__ import annotations

from dataclasses import asdict, replace
from typing import Any

import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from ..functions.expressions import blend, excess_score, risk_tier
from ..operators.explain import explain
from ..operators.features import feature_matrix, priced_features
from ..operators.forest import NODE_SCHEMA, fit_forest, forest_score
from ..operators.peers import fit_peers, peer_score
from ..operators.stats import evaluation_report, robust_baseline, scaler_fit, standardised
from ..session import materialize
from . import model_store

SESSION_KEY = ["user_id", "day"]


class RiskEstimator(Estimator):
    """Fits on rows whose `split` is 'train'; expects a materialized feature matrix."""

    def __init__(self, cfg: EngineConfig, bigrams: DataFrame | None = None):
        """`bigrams` are the pair counts that priced the matrix; the model keeps them."""
        super().__init__()
        self.cfg, self.bigrams = cfg, bigrams

    def _fit(self, dataset: DataFrame) -> "RiskModel":
        cfg, columns = self.cfg, list(self.cfg.features)
        train = dataset.where(F.col("split") == "train")
        scaler = scaler_fit(train, columns).first().asDict()
        if not scaler["n"]:
            raise ValueError("no training sessions before the split day")
        scaled = train.select(*SESSION_KEY, *standardised(columns, scaler))
        nodes = fit_forest(scaled, columns, SESSION_KEY, scaler["n"], cfg).toPandas()
        model = RiskModel(cfg, scaler, nodes, None, None, self.bigrams)
        raw = materialize(train.select(model.raw_forest_score().alias("raw")), "raw-scores")
        fit = robust_baseline(raw, F.col("raw")).first()
        model.forest_fit = {"baseline": fit["baseline"], "scale": fit["scale"]}
        model.roles = materialize(fit_peers(train, columns, cfg, keep=materialize), "role-model")
        return model


class RiskModel(Model):
    """Frozen baselines. `scaler`, `forest_fit` and the node table have a fixed size; the role
    model is a table of one row per role, the pair counts one of a row per pair of tokens."""

    def __init__(self, cfg: EngineConfig, scaler: dict, nodes: pd.DataFrame,
                 forest_fit: dict | None, roles: DataFrame | None, bigrams: DataFrame | None = None):
        super().__init__()
        self.cfg, self.scaler, self.nodes = cfg, scaler, nodes
        self.forest_fit, self.roles, self.bigrams = forest_fit, roles, bigrams

    def price(self, activity: DataFrame, directory: DataFrame, answers: DataFrame) -> DataFrame:
        """Scored sessions of new activity, their sequences priced by the counts of the fitting run."""
        if self.bigrams is None:
            raise ValueError("the model was fitted without pair counts")
        features = materialize(feature_matrix(activity, directory, answers, self.cfg, self.bigrams), "features")
        return self.transform(features)

    def raw_forest_score(self):
        spark = SparkSession.getActiveSession()
        rows = min(self.cfg.tree_rows, self.scaler["n"])
        return forest_score(self.nodes, standardised(self.cfg.features, self.scaler), rows, spark)

    def add_scores(self, features: DataFrame) -> DataFrame:
        cfg = self.cfg
        raw = features.withColumn("_raw", self.raw_forest_score())
        forest = excess_score(F.col("_raw"), F.lit(self.forest_fit["baseline"]),
                              F.lit(self.forest_fit["scale"]), cfg.forest_k)
        scored = raw.withColumn("isolation_forest_score", forest).drop("_raw")
        scored = peer_score(scored, list(cfg.features), self.roles, cfg).drop("peer_distance")
        return scored.withColumn("risk_score", blend(F.col("isolation_forest_score"), F.col("peer_group_score"), cfg))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Scores, tier and explanation of each session. Sessions of unseen roles carry a NULL
        risk score (see `rejects`) unless `allow_partial` is set."""
        cfg = self.cfg
        scored = self.add_scores(dataset)
        scored = explain(scored, list(cfg.features), self.roles, cfg, written=True)
        scored = scored.withColumn("risk_tier", risk_tier(F.col("risk_score"), cfg))
        ids = ["user_id", "role", "day", "is_malicious", "scenario_id", "split"]
        return scored.select(*[c for c in ids if c in dataset.columns], "isolation_forest_score",
                             "peer_group_score", "risk_score", "risk_tier", "top_features")

    # ---- persistence -----------------------------------------------------------------------
    def save(self, folder: str) -> int:
        """Publish the model as the next version in `folder`; see `model_store`."""
        spark = self.roles.sparkSession
        parts = {"roles": self.roles, "forest": spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1)}
        if self.bigrams is not None:
            parts["bigrams"] = self.bigrams
        settings = {"scaler": self.scaler, "forest_fit": self.forest_fit,
                    "cfg": {**asdict(self.cfg), "start_day": self.cfg.start_day.isoformat()}}
        return model_store.publish(spark, folder, parts, settings)

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> "RiskModel":
        parts, kept = model_store.read(spark, folder, version)
        return RiskModel(_config(kept["cfg"]), kept["scaler"], parts["forest"].toPandas(), kept["forest_fit"],
                         parts["roles"], parts.get("bigrams"))


def _config(kept: dict[str, Any]) -> EngineConfig:
    import datetime as dt

    def frozen(value):
        return tuple(frozen(v) for v in value) if isinstance(value, list) else value

    cells = {k: frozen(v) for k, v in kept.items()}
    return replace(EngineConfig(), **{**cells, "start_day": dt.date.fromisoformat(cells["start_day"])})


def rejects(scored: DataFrame) -> DataFrame:
    """Sessions that could not be scored: their role had no training sessions."""
    return scored.where(F.col("risk_score").isNull())


def run_detection(activity: DataFrame, directory: DataFrame, answers: DataFrame, cfg: EngineConfig) -> dict:
    """load -> features -> split -> fit -> score; returns features, model and scored table."""
    features, bigrams = priced_features(activity, directory, answers, cfg)
    features = materialize(features, "features")
    model = RiskEstimator(cfg, bigrams).fit(features)
    return {"features": features, "model": model, "scored": model.transform(features)}


def evaluate(scored: DataFrame) -> DataFrame:
    """Held-out detection report."""
    return evaluation_report(scored.where("split = 'test'"))
